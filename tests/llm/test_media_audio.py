import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from trackloom.llm.media_audio import AudioShape, audio_columns, read_wav, resample, segments, write_wav
from trackloom.llm.queries import op8_media_audio


@pytest.mark.parametrize(("rate", "to"), [(16_000, 8_000), (16_000, 6_000), (8_000, 12_000)])
def test_resampling_keeps_a_tone(rate, to):
    tone = lambda r: np.sin(2 * np.pi * 440 * np.arange(r) / r)
    out = resample(tone(rate), rate, to)
    assert len(out) == to and np.abs(out - tone(to))[100:-100].max() < 1e-3


def test_segments_and_wav():
    shape = AudioShape()
    db = np.array([0.0, 0, 1, 5, 1, 0, 0, 1, 1, 0, 0, 4])
    hop = shape.hop / shape.rate
    assert [round(a / hop) for a, _ in segments(db, shape)] == [2, 11]
    assert read_wav(write_wav(b"abc", 8000)) == (b"abc", 8000)
    with pytest.raises(ValueError):
        read_wav(b"x")


def test_columns(spark, make_docs, tmp_path):
    texts = {1: None, 2: "", 3: "é" * 40, 4: "hello " * 30_000, 5: "x" * 64}
    docs = make_docs([*texts.items(), (3, texts[3]), (None, "n")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = op8_media_audio(spark, str(tmp_path)).collect()
    assert len(out) == 7
    for r in out:
        raw = ("n" if r.doc_id is None else texts[r.doc_id] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(write_wav(payload, 16_000)), sha256(write_wav(payload, 16_000)).hexdigest())
    assert len({r.feature for r in out if r.doc_id == 3}) == 1 and len({r.feature for r in out if r.doc_id in (1, 2)}) == 1
    row = audio_columns(docs.where("doc_id = 4")).first()
    table = pa.ipc.open_stream(bytes(row.tensors)).read_all()
    assert table.column("tensor").type.shape == [64, 20] and len(table) == -(-row.n_frames // 64)
    ends = table.column("end_s").to_numpy()
    assert (np.diff(table.column("start_s").to_numpy()) > 0).all() and abs(ends[-1] - 180_032 / 16_000) < 0.05
    assert audio_columns(docs.limit(0)).count() == 0
