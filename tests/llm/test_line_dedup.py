from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm.line_dedup import PerfectHash, line_dedup

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows, min_chars=40, min_docs=5):
    held = defaultdict(set)
    low = -(1 << 63)
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(low if d is None else d)
    hot = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if key(x) not in hot or hot[key(x)] == (low if d is None else d)]
        out.append((d, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=repr)


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, (1 << 64) - 1), max_size=3000))
def test_perfect_hash_is_minimal_and_survives_bytes(keys):
    keys = np.array(sorted(keys), np.uint64)
    table = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(table.number(keys).tolist()) == list(range(len(keys)))
    assert len(table.number(np.arange(5, dtype=np.uint64))) == 5


def test_matches_brute_force(spark, make_docs):
    a, b, c = "A line that many documents share, number one.", "  a LINE that many documents share, number one.\t", "éÉ another long line that only some share !!!"
    rows = [(i, f"own {i}\n{a if i % 2 else b}\n{'x' * 39}\n\n{c if i < 4 else c.upper()}\nend") for i in range(9)]
    rows += [(9, None), (10, ""), (11, a), (11, a), (12, "\n".join([a] * 3 + [c] * 2)), (None, a), (None, c), (13, "z" * 200_000 + "\n" + a)]
    docs = make_docs(rows)
    for per_task in (400_000, 3):  # the second deals every shard's probes among copies
        out = line_dedup(docs, probes_per_task=per_task, keys_per_shard=2)
        assert set(out.columns) == set(docs.columns) | {"n_lines", "n_dropped"}
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=repr) == brute(rows)
    assert line_dedup(docs.limit(0)).count() == 0
