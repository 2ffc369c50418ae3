"""Every registered query of the library against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from trackloom.plans.queries import ORACLE, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    if name not in ORACLE:
        assert rows
        return
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(r) for r in duck.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({ORACLE[name]})").fetchall()), key=repr)
    assert len(rows) == len(want)
    assert all(close(x, y) for a, b in zip(rows, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.fixture()
def against_sql(spark, tmp_path):
    """Compares a query with its SQL on tables of one's own, rows as they are."""

    def compare(name, **tables):
        con = duckdb.connect()
        for table, sql in tables.items():
            con.sql(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        cols = ", ".join(f'"{c}"' for c in df.columns)
        got, want = (sorted(map(tuple, rows), key=repr) for rows in (df.collect(), con.sql(f"SELECT {cols} FROM ({ORACLE[name]})").fetchall()))
        assert got and got == want
        assert list(map(repr, got)) == list(map(repr, want))

    return compare


EVENT = "'click' AS event_type, '{}' AS props"


def test_tracks_named_like_the_halves_of_a_track(against_sql):
    against_sql("merged_by_hand", events=f"SELECT i AS event_id, TIMESTAMP '2024-01-25' + to_hours((i // 6 * 40)::INT) AS ts, [7, 8, 10001, 10002, 10003, 20000][i % 6 + 1]::BIGINT AS user_id, i::DOUBLE AS value, {EVENT} FROM range(60) r(i)")


def test_angles_beyond_a_turn(against_sql):
    """Steps of the tail's angle over half a turn, which were unwrapped."""
    against_sql("orientation_by_movement", events=f"SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_minutes(i::INT) AS ts, i % 3 AS user_id, (CASE WHEN i % 7 = 0 THEN 326.0 ELSE i * 37 % 50 END)::DOUBLE AS value, {EVENT} FROM range(300) r(i)")


def test_cells_at_their_borders(against_sql):
    """Whether the third value lies on a cell's border hangs on the order in which the mean is added up."""
    values = [49.3, 35.4, 27.6, 84.1, 17.4, 52.0]
    against_sql("grid_coverage", events=f"SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_minutes(i::INT) AS ts, 1::BIGINT AS user_id, {values}[i + 1]::DOUBLE AS value, {EVENT} FROM range(6) r(i)")


def test_turns_that_round_to_zero_from_below(against_sql):
    """One heading all along, but for rounding: some of its changes are -0.0 in the SQL."""
    against_sql("legacy_velocity", events=f"SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_minutes(i::INT) AS ts, 1::BIGINT AS user_id, 20.1 + i * 0.37::DOUBLE AS value, {EVENT} FROM range(60) r(i)")


def test_headings_that_are_equal_but_for_the_last_bit(against_sql):
    """Straight ways with gaps: a heading comes from steps of several lengths, so that only rounding changes it."""
    against_sql("legacy_velocity", events=f"SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_minutes(i::INT) AS ts, (i // 40)::BIGINT AS user_id, (CASE WHEN i % 9 = 0 OR i % 7 = 1 THEN 0 ELSE 20.1 + i % 40 * (0.13 + i // 40 * 0.07) END)::DOUBLE AS value, {EVENT} FROM range(1600) r(i)")


def test_numbers_next_to_ties(against_sql):
    """Each group is one p that ends in a five; whether it is rounded up hangs on the last bit of its product with 10^6."""
    against_sql("q_values_by_group", events="SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_minutes(i::INT) AS ts, 1::BIGINT AS user_id, i::VARCHAR AS event_type, (60.00005 + i * 0.0001)::DOUBLE AS value, '{}' AS props FROM range(300) r(i)")


def test_tables_in_folders(spark, tmp_path):
    for name in ("events", "orders"):
        spark.range(4).repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    assert sorted(map(tuple, QUERIES["table_files"](spark, str(tmp_path)).collect())) == [("events.parquet", 0), ("orders.parquet", 1)]
