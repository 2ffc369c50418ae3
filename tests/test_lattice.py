"""Wells of drawn plates, turned and shifted."""

import numpy as np
import pytest

from trackloom.functions import lattice
from trackloom.operators import wells


def plate(turn, dx, dy, rows=4, cols=6, spacing=60, wall=6, size=(330, 450), seed=0, missing=()):
    """(image, middles by (row, column)) of light wells between dark walls, in the dark."""
    y, x = np.mgrid[: size[0], : size[1]]
    cx, cy = size[1] / 2 + dx, size[0] / 2 + dy
    u, v = (x - cx) * np.cos(turn) + (y - cy) * np.sin(turn), -(x - cx) * np.sin(turn) + (y - cy) * np.cos(turn)
    ku, kv = np.floor(u / spacing + cols / 2), np.floor(v / spacing + rows / 2)
    fu, fv = (u / spacing + cols / 2) % 1 * spacing, (v / spacing + rows / 2) % 1 * spacing
    well = (ku >= 0) & (ku < cols) & (kv >= 0) & (kv < rows) & (np.minimum(np.minimum(fu, spacing - fu), np.minimum(fv, spacing - fv)) > wall / 2)
    for r, c in missing:
        well &= ~((kv == r) & (ku == c))
    a = np.where(well, 170, 60) + np.random.default_rng(seed).normal(0, 8, size)
    along = lambda k, n: (k + 0.5 - n / 2) * spacing
    middles = {(r, c): (cx + along(c, cols) * np.cos(turn) - along(r, rows) * np.sin(turn), cy + along(c, cols) * np.sin(turn) + along(r, rows) * np.cos(turn)) for r in range(rows) for c in range(cols) if (r, c) not in missing}
    return np.clip(a, 0, 255).astype(np.uint8), middles


@pytest.mark.parametrize(("turn", "dx", "dy"), [(0.0, 0, 0), (0.05, 7, -9), (-0.08, -5, 4), (0.02, 12, 11)])
def test_wells_of_turned_and_shifted_plates(turn, dx, dy):
    a, want = plate(turn, dx, dy, missing=((1, 2),))
    cells, contrast, spacing, _ = lattice.find_cells(a, 40, 90)
    got = {(int(r), int(c)): (x, y) for r, c, x, y in cells}
    assert set(got) == set(want) and (contrast > 0).all() and abs(spacing - 60) < 1
    assert max(np.hypot(got[k][0] - want[k][0], got[k][1] - want[k][1]) for k in want) < 2


def test_wells_of_tables(spark):
    images = {0: plate(0.03, 3, 3)[0], 1: 255 - plate(0.03, 3, 3)[0], 2: plate(0, 0, 0, size=(660, 900), spacing=120, wall=12)[0]}
    rows = [(k, *a.shape, bytearray(a.tobytes())) for k, a in images.items()] + [(3, 50, 50, None), (4, 80, 80, bytearray(np.full(6400, 9, np.uint8).tobytes()))]
    frames = spark.createDataFrame(rows, "file_id int, h int, w int, pixels binary")
    out = wells.find_wells(frames.where("file_id in (0, 3, 4)"), 40, 90).collect()
    assert len(out) == 24 and {r["file_id"] for r in out} == {0} and {r["well_name"] for r in out} == {f"{a}{n}" for a in "ABCD" for n in range(1, 7)}
    assert wells.find_wells(frames.where("file_id = 1"), 40, 90, dark_walls=False).count() == 24
    large = wells.find_wells(frames.where("file_id = 2"), 80, 180).toPandas().set_index("well_name")
    want = plate(0, 0, 0, size=(660, 900), spacing=120, wall=12)[1]
    assert abs(large.loc["A1", "x"] - want[0, 0][0]) < 3 and abs(large.loc["D6", "y"] - want[3, 5][1]) < 3
    assert wells.find_wells(frames.limit(0), 40, 90).count() == 0
