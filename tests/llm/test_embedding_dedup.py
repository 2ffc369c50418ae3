import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm.embedding_dedup import _local_roots, embedding_dedup, spread_out, unit_rows

SCHEMA = "vec_id long, embedding array<double>, label int, id long, root long, cell int, n double, copies string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, 4.0, "c") for i, v in rows], SCHEMA)


def brute(rows, threshold):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good}
    near = {i: [] for i in range(len(rows))}
    for k, i in enumerate(good):
        for j in good[k + 1 :]:
            if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                near[i].append(j)
                near[j].append(i)
    group = {}
    for i in range(len(rows)):
        if i not in group:
            todo, seen = [i], {i}
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
            group |= dict.fromkeys(seen, low)
    return sorted(((r[0], len(near[i]), group[i], r[0] == group[i]) for i, r in enumerate(rows)), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def crowd(seed, n, dim, groups, noise):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, dim))
    for k in range(groups):
        centre = rng.normal(size=dim)
        some = rng.choice(n, 12, replace=False)
        out[some] = centre + noise * rng.normal(size=(12, dim))
    return [(i, v.tolist()) for i, v in enumerate(out)]


@pytest.mark.parametrize("reach", [0.5, 1.0])
def test_many_cells_and_blocks_find_what_brute_force_finds(spark, reach):
    rows = crowd(3, 500, 24, 20, 0.17)
    got = embedding_dedup(frame(spark, rows), cell_rows=40, block_rows=25, reach=reach)
    assert result(got) == brute(rows, 0.95)


def test_full_reach_loses_no_link_at_the_border(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((base, base + 0.2 * rng.normal(size=base.shape))))]
    got = embedding_dedup(frame(spark, rows), threshold=0.9, cell_rows=10, block_rows=16, reach=1.0)
    assert result(got) == brute(rows, 0.9)


def test_nulls_zeros_infinities_lengths_copies_and_signed_zeros(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, [2.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [1.0, float("nan")]), (9, [float("inf"), 1.0]),
        (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e200, 0.0]), (13, [1e-300, 0.0]), (None, [0.0, 1.0]), (None, [0.0, 1.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (None, [5.0, -5.0]),
    ]
    got = {r["vec_id"]: r for r in embedding_dedup(frame(spark, rows)).where("vec_id is not null and vec_id <> 20").collect()}
    assert {i for i, r in got.items() if r["component_id"] == 1} == {1, 2, 3, 12, 13}
    assert got[1]["n_links"] == 4 and got[1]["kept"] and not got[2]["kept"]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (4, 5, 6, 7, 8, 9, 10, 11))
    ones = embedding_dedup(frame(spark, rows)).where("component_id = 20").collect()
    assert len(ones) == 4 and {r["n_links"] for r in ones} == {3}
    alone = embedding_dedup(frame(spark, rows)).where("vec_id is null and component_id is null").collect()
    assert [(r["n_links"], r["kept"]) for r in alone] == [(0, True)]


def test_empty_tables_and_float_columns(spark):
    empty = frame(spark, [])
    assert embedding_dedup(empty).count() == 0
    assert embedding_dedup(frame(spark, [(1, None), (2, [0.0])])).where("n_links > 0 or not kept").count() == 0
    rows = [(0, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.0, 1.0])]
    floats = frame(spark, rows).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert result(embedding_dedup(floats)) == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True)]


def test_a_third_of_all_rows_in_one_group(spark):
    rng = np.random.default_rng(9)
    far = rng.normal(size=(200, 16))
    near = rng.normal(size=16) + 0.05 * rng.normal(size=(100, 16))
    near[50:] = near[0]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((far, near)))]
    random.Random(1).shuffle(rows)
    assert result(embedding_dedup(frame(spark, rows), cell_rows=30, block_rows=20)) == brute(rows, 0.95)


def test_recall_near_the_threshold(spark):
    """Pairs with cosines from 0.95 to 0.96 in random directions, the hardest case: at least 0.98 are found, none below 0.95."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9501, 0.96, size=(1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((base, cosine * base + np.sqrt(1 - cosine**2) * side)))]
    links = embedding_dedup(frame(spark, rows), cell_rows=64).agg(F.sum("n_links")).first()[0]
    assert 0.98 * 3000 <= links <= 3000


def test_local_roots_and_spread_out_centres():
    x, y = np.array([4, 3, 2, 7]), np.array([3, 2, 1, 6])
    assert _local_roots(8, x, y).tolist() == [0, 1, 1, 1, 1, 5, 6, 6]
    centres = np.array([[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [0.01, 1.0]])
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    assert len(spread_out(centres, 0.95)) == 2


def test_unit_rows_pads(spark):
    import pyarrow as pa

    rows, lengths = unit_rows(pa.array([[3.0, 4.0], [2.0]]), 3)
    assert rows.tolist() == [[0.6, 0.8, 0.0], [1.0, 0.0, 0.0]] and lengths.tolist() == [2, 1]
