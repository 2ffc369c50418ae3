"""Frames from image files: folders of numbered images, packed camera files, uncompressed TIFF stacks.

Files are read by Spark's ``binaryFile`` source and decoded in the tasks that hold them; a file that cannot be decoded
gives a row with an error in place of pixels, so that one bad file stops nothing.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRAMES = "path string, page int, h int, w int, bits int, pixels binary, error string"


def decode_png(raw: bytes) -> list[np.ndarray]:
    """A PNG of 8 or 16 bits a sample without interlacing, grey or colours, as grey."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data, head = 8, b"", None
    while at + 8 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    if head is None or head[2] not in (8, 16) or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("this kind of PNG is not read")
    w, h, depth, channels = head[0], head[1], head[2], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    step = channels * depth // 8
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h + 1, step + w * step), np.uint8)  # with a row above and a pixel on the left of zeros
    for y in range(h):
        kind, line, above, mine = rows[y, 0], rows[y, 1:], out[y], out[y + 1]
        if kind == 0:
            mine[step:] = line
        elif kind == 2:
            mine[step:] = line + above[step:]
        else:
            for x in range(len(line)):  # these filters need the pixel before
                a, b, c = int(mine[x]), int(above[x + step]), int(above[x])
                if kind == 1:
                    near = a
                elif kind == 3:
                    near = (a + b) // 2
                else:
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                mine[x + step] = (int(line[x]) + near) & 255
    a = out[1:, step:].reshape(h, w, step)
    a = a[..., 0::2].astype(np.uint16) << 8 | a[..., 1::2] if depth == 16 else a
    return [a[..., 0] if channels < 3 else np.rint(a[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(a.dtype)]


def decode_pgm(raw: bytes) -> list[np.ndarray]:
    """A binary grey map of the PNM family."""
    fields, at = [], 0
    while len(fields) < 4:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("the header ends early")
        fields.append(raw[at:end])
        at = end
    if fields[0] != b"P5":
        raise ValueError("not a binary grey map")
    w, h, most = (int(x) for x in fields[1:])
    kind = np.dtype(np.uint8) if most < 256 else np.dtype(">u2")
    a = np.frombuffer(raw, kind, w * h, at + 1).reshape(h, w)
    return [a.astype(np.uint8 if most < 256 else np.uint16)]


def decode_tiff(raw: bytes) -> list[np.ndarray]:
    """All pages of an uncompressed grey TIFF of 8 or 16 bits."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, pages = struct.unpack_from(order + "I", raw, 4)[0], []
    while at:
        tags: dict[int, list[int]] = {}
        n = struct.unpack_from(order + "H", raw, at)[0]
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
            size = {1: 1, 3: 2, 4: 4}.get(kind)
            if size is None:
                continue
            where = at + 10 + 12 * k
            if size * count > 4:
                where = struct.unpack_from(order + "I", raw, where)[0]
            tags[tag] = list(struct.unpack_from(f"{order}{count}{'BHI'[(1, 2, 4).index(size)]}", raw, where))
        if tags.get(259, [1])[0] != 1 or tags.get(277, [1])[0] != 1 or tags.get(258, [1])[0] not in (8, 16):
            raise ValueError("this kind of TIFF is not read")
        w, h, kind = tags[256][0], tags[257][0], np.dtype(np.uint8 if tags[258][0] == 8 else order + "u2")
        data = b"".join(raw[a : a + b] for a, b in zip(tags[273], tags[279], strict=True))
        a = np.frombuffer(data, kind, w * h).reshape(h, w)
        pages.append(a.astype(np.uint8 if kind.itemsize == 1 else np.uint16))
        at = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]
    return pages


def decode_packed(raw: bytes) -> list[np.ndarray]:
    """A camera file of packed 12-bit pixels: three bytes hold two, and the last 40 bytes hold the size.

    Rows run from the bottom, pixels from the right.
    """
    if len(raw) < 40:
        raise ValueError("the file is too short")
    w, h = (int(v) for v in np.frombuffer(raw[-40:], "<u2")[14:16])
    packed = np.frombuffer(raw[:-40], np.uint8)
    if w < 2 or h < 1 or len(packed) != w * h * 3 // 2:
        raise ValueError("the size does not fit")
    one, mid, two = (packed[k::3].astype(np.uint16) for k in range(3))
    out = np.zeros((h, w), np.uint16)
    out[::-1, ::-2] = ((one << 4) + (mid & 15)).reshape(h, -1)
    out[::-1, -2::-2] = ((two << 4) + (mid >> 4)).reshape(h, -1)
    return [out]


DECODERS: dict[str, Callable[[bytes], list[np.ndarray]]] = {"png": decode_png, "pgm": decode_pgm, "tif": decode_tiff, "tiff": decode_tiff, "dat": decode_packed}


def decoded(files: DataFrame) -> DataFrame:
    """A row for each page of each file (path, content) by its extension: h, w, bits, pixels, or an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    pages = DECODERS[path.rsplit(".", 1)[-1].lower()](raw)
                except (KeyError, ValueError, struct.error, zlib.error, IndexError) as e:
                    rows.append((path, 0, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                rows += [(path, k, a.shape[0], a.shape[1], 8 * a.itemsize, np.ascontiguousarray(a).tobytes(), None) for k, a in enumerate(pages)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FRAMES.split(", ")], dtype=object)

    return files.select("path", "content").mapInPandas(run, FRAMES)


def image_frames(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """(frame_number, page, h, w, bits, pixels, error, path) of a folder's images, by the last number in their names, then
    by name."""
    return numbered(decoded(spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(folder)))


def numbered(frames: DataFrame) -> DataFrame:
    """Adds frame_number, from 0: by the last number in the names, then by name and page."""
    number = F.regexp_extract("path", r"(\d+)[^\d/]*$", 1).cast("decimal(38,0)")
    return frames.withColumn("frame_number", F.row_number().over(Window.orderBy(number.asc_nulls_first(), "path", "page")) - 1)


def camera_frames(spark: SparkSession, folder: str) -> DataFrame:
    """The same for packed camera files <number>spool*.dat, whose numbers may be written backwards."""
    frames = decoded(spark.read.format("binaryFile").option("pathGlobFilter", "*.dat").load(folder))
    digits = F.regexp_extract("path", r"/(\d+)spool[^/]*$", 1)
    frames = frames.withColumns({"_a": digits.cast("bigint"), "_b": F.reverse(digits).cast("bigint")})
    gaps = frames.agg((F.max("_a") - F.min("_a") + 1 == F.count_distinct("_a")).alias("_forward"))
    frames = frames.join(F.broadcast(gaps), F.lit(True)).withColumn("_n", F.when(F.col("_forward"), F.col("_a")).otherwise(F.col("_b")))
    return frames.withColumn("frame_number", F.row_number().over(Window.orderBy("_n", "path")) - 1).drop("_a", "_b", "_forward", "_n")


def readable(frames: DataFrame) -> DataFrame:
    """(path, is_good): whether a file could be decoded."""
    return frames.groupBy("path").agg(F.every(F.col("error").isNull()).alias("is_good"))
