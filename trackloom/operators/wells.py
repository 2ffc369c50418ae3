"""Plates of wells: maps, lookup of wells, missing lattice cells."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.lattice import find_cells
from trackloom.operators.joins import small

#: Plate shapes (rows, columns) by number of wells.
PLATES = {24: (4, 6), 48: (6, 8), 96: (8, 12)}


def plate_map(spark: SparkSession, n_wells: int, channels: int, rotated: bool = False) -> DataFrame:
    """(channel, row, col, well_name): the plate's wells, dealt to ``channels`` cameras in equal blocks of columns, the
    upper half of rows to odd cameras; ``rotated`` plates are read from the far corner."""
    rows, cols = PLATES[n_wells]
    wide, high = cols // (channels // 2), rows // 2
    out = []
    for r in range(rows):
        for c in range(cols):
            rr, cc = (rows - 1 - r, cols - 1 - c) if rotated else (r, c)
            out.append((2 * (c // wide) + 1 + (r >= high), r % high, c % wide, f"{chr(65 + rr)}{cc + 1}"))
    return spark.createDataFrame(out, "channel int, row int, col int, well_name string")


def label_axis(boxes: DataFrame, keys: Sequence[str], centre: str, gap: float, name: str) -> DataFrame:
    """Numbers rows or columns of boxes from 0: a new one begins where sorted centres are more than ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy(centre)
    new = F.when(F.col(centre) - F.lag(centre).over(w) > gap, 1).otherwise(0)
    return boxes.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def find_wells(backgrounds: DataFrame, smallest: float, largest: float, keys: Sequence[str] = ("file_id",), most_turn: float = 0.1, dark_walls: bool = True) -> DataFrame:
    """(keys, row, col, well_name, x, y, x_min, x_max, y_min, y_max, contrast): the wells in each image (h, w, pixels).

    The lattice of wells may be turned by up to ``most_turn`` radians and have any place and a spacing from ``smallest`` to
    ``largest`` pixels (``lattice.find_cells``); rows and columns count from the first that is seen.  Boxes lie upright
    around the wells' middles.  Images without a lattice, and NULL images, have no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in backgrounds.schema}
    columns = ["row", "col", "well_name", "x", "y", "x_min", "x_max", "y_min", "y_max", "contrast"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                if r["pixels"] is None:
                    continue
                a = np.frombuffer(r["pixels"], np.uint8).reshape(r["h"], r["w"])
                cells, contrast, spacing, _ = find_cells(a, smallest, largest, most_turn, dark_walls)
                for (i, j, x, y), c in zip(cells.tolist(), contrast.tolist(), strict=True):
                    rows.append((*(r[k] for k in keys), int(i), int(j), f"{chr(65 + int(i))}{int(j) + 1}", x, y, x - spacing / 2, x + spacing / 2, y - spacing / 2, y + spacing / 2, c))
            yield pd.DataFrame(rows, columns=[*keys, *columns])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", row int, col int, well_name string, x double, y double, x_min double, x_max double, y_min double, y_max double, contrast double"
    return backgrounds.select(*keys, "h", "w", "pixels").mapInPandas(run, schema)


def lattice_lines(boxes: DataFrame, keys: Sequence[str], line: str, centre: str) -> DataFrame:
    """(keys, line, centre, border): mean centre of each row or column, and the middle to the next."""
    mean = boxes.groupBy(*keys, line).agg(F.avg(centre).alias(centre))
    nxt = F.lead(centre).over(Window.partitionBy(*keys).orderBy(line))
    return mean.withColumn("border", (F.col(centre) + nxt) / 2)


def camera_wells(files: DataFrame, cameras: DataFrame, plates: DataFrame) -> DataFrame:
    """Wells of every file, by the camera serial number in its name and the camera's (rig, channel)."""
    serial = F.regexp_extract("path", r"(?<=\.)(\d{6,})(?=/|\.|_)", 1)
    return files.withColumn("serial", serial).join(small(cameras), "serial", "left").join(small(plates), "channel", "left")
