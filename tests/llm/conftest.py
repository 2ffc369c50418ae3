import pytest

#: Columns whose names operators use for results of their own.
CLASH = "size long, hash long, key string, n long, kept boolean, score double, shard long, `_rest` string, n_lines long, host string"


@pytest.fixture
def make_docs(spark):
    """documents from (doc_id, text[, source]) tuples, with extra columns of clashing names."""

    def make(rows, clash=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (f", {CLASH}" if clash else "")
        extra = (1, 2, "k", 3, True, 0.5, 4, "r", 5, "h") if clash else ()
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None, *extra) for r in rows]
        return spark.createDataFrame(full, schema)

    return make
