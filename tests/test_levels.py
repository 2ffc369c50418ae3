"""Names and values of the master summary by plate, well, animal and fold, against pandas."""

import numpy as np
import pandas as pd
import pytest

from trackloom.functions.timeseries import Track
from trackloom.operators import features as X
from trackloom.operators import levels as V

ALL = X.SERIES + X.EVENTS + X.AUXILIARY + V.BLOB_SERIES


def test_names():
    names = V.statistic_names(ALL)
    assert len(names) == len(set(names)) == 4548
    per = {"all": 560, "norm": 288, "mode": 1656, "signed": 344, "signed_norm": 156, "signed_mode": 1032, "blob": 112, "blob_mode": 336}
    assert sum(per.values()) + 24 + 40 == 4548 and len(V.event_names()) == 24 and len(V.path_names(True) + V.path_names(False)) == 40
    assert len(V.statistic_names(ALL, only_absolute=True)) == 4548 - per["signed"] - per["signed_norm"] - per["signed_mode"]
    some = {"speed_50th", "d_speed_IQR", "speed_norm_90th", "curvature_head_abs_10th", "curvature_head_norm_abs_50th", "curvature_head_w_forward_abs_IQR", "curvature_head_w_paused_10th", "orientation_food_edge_in_inside_50th", "head_tail_distance_norm_50th", "d_area_norm_50th", "blob_hu3_w_backward_90th", "motion_mode_paused_fraction", "turn_inter_frequency", "path_transit_time_body_norm_95th", "path_coverage_head"}
    assert some <= set(names)
    assert not {"head_tail_distance_50th", "d_speed_norm_50th", "orientation_food_edge_50th"} & set(names)


def make(spark, n=120):
    rng = np.random.default_rng(0)
    rows = []
    for worm in (1, 2, 3):
        for i in range(n):
            rows.append((0, worm, i, float(rng.normal(0, 50)) if i % 17 else None, float(rng.normal()), float(1000 + 50 * worm + rng.normal()), float(rng.uniform(0, 3000)), float(rng.uniform(0, 3000)), int(rng.integers(-1, 2)), float(rng.uniform(10, 20)), "n/a" if worm == 3 else "A1"))
    cols = ["file_id", "worm_index", "timestamp", "speed", "angular_velocity", "length", "coord_x_body", "coord_y_body", "motion_mode", "blob_area", "well_name"]
    pdf = pd.DataFrame(rows, columns=cols)
    return spark.createDataFrame(rows, "file_id int, worm_index int, timestamp int, speed double, angular_velocity double, length double, coord_x_body double, coord_y_body double, motion_mode int, blob_area double, well_name string"), pdf


def plain(pdf):
    """Some statistics of one group, straight from their definitions."""
    out = {}

    def block(name, x):
        q = x.quantile([0.1, 0.25, 0.5, 0.75, 0.9])
        out.update({f"{name}_10th": q[0.1], f"{name}_50th": q[0.5], f"{name}_90th": q[0.9], f"{name}_IQR": q[0.75] - q[0.25]})

    m = pdf.groupby("worm_index")["length"].transform("median")
    block("speed", pdf["speed"])
    block("speed_norm", pdf["speed"] / m)
    block("angular_velocity", pdf["angular_velocity"])
    block("angular_velocity_abs", pdf["angular_velocity"].abs())
    for code, text in {-1: "backward", 0: "paused", 1: "forward"}.items():
        block(f"angular_velocity_w_{text}_abs", pdf["angular_velocity"].where(pdf["motion_mode"] == code).abs())
        block(f"speed_w_{text}", pdf["speed"].where(pdf["motion_mode"] == code))
    d = pdf.groupby("worm_index")["blob_area"].transform(lambda x: (x.shift(-4) - x.shift(4)) / (8 / 25))
    block("blob_area", pdf["blob_area"])
    block("d_blob_area", d)
    for tag, size, area in (("", 250.0, 62500.0), ("_norm", 0.25 * pdf["length"].median(), 1.0)):
        cells = pd.DataFrame({c: ((pdf[f"coord_{c}_body"] - pdf[f"coord_{c}_body"].mean()) / size).round() for c in "xy"})
        n = cells.value_counts()
        runs = [len(g) for _, w in cells.groupby(pdf["worm_index"]) for _, g in w.groupby((w != w.shift()).any(axis=1).cumsum())]
        out[f"path_coverage_body{tag}"] = len(n) * area
        out[f"path_density_body{tag}_95th"] = np.percentile(n, 95) / n.sum()
        out[f"path_transit_time_body{tag}_50th"] = np.percentile(runs, 50) / 25
    return out


def as_dict(rows, *keys):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), {})[r.statistic] = r.value
    return out


def near(got, want):
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-12), k


def test_levels(spark):
    df, pdf = make(spark)
    plate = as_dict(V.master_summary(df.drop("well_name"), ["file_id"], 25.0).collect(), "file_id")
    assert set(plate) == {(0,)}
    near(plate[0,], plain(pdf))
    assert set(plate[0,]) <= set(V.statistic_names([*df.columns, "d_blob_area"]))
    wells = as_dict(V.plate_summary(df, ["file_id"], 25.0).collect(), "well_name")
    assert set(wells) == {("A1",)}
    near(wells["A1",], plain(pdf[pdf["well_name"] == "A1"].reset_index(drop=True)))
    summary, info = V.trajectory_summary(df.drop("well_name"), ["file_id"], 25.0)
    each = as_dict(summary.collect(), "worm_index")
    near(each[2,], plain(pdf[pdf["worm_index"] == 2].reset_index(drop=True)))
    assert {(r.worm_index, r.tot_time, r.frac_valid) for r in info.collect()} == {(w, 120 / 25, 1.0) for w in (1, 2, 3)}
    # The summary of one animal's rows is that animal's summary.
    one = as_dict(V.master_summary(df.where("worm_index = 2").drop("well_name"), ["file_id"], 25.0).collect(), "file_id")[0,]
    near({k: v for k, v in each[2,].items() if v is not None}, {k: v for k, v in one.items() if v is not None})
    folds = V.summary_of("current", "plate_augmented")(df.drop("well_name"), ["file_id"], 25.0, n_folds=2, seconds=2.0, share=0.5)
    assert {r.i_fold for r in folds.select("i_fold").distinct().collect()} == {0, 1}
    table = V.wide(V.master_summary(df.drop("well_name"), ["file_id"], 25.0), ["file_id"], ["speed_50th", "nothing"]).first()
    assert table.speed_50th == pytest.approx(pdf["speed"].median()) and table.nothing is None
    with pytest.raises(ValueError):
        V.summary_of("current", "nowhere")


def test_events_in_summary(spark):
    rows = [(0, w, i, 1 if i < 10 else 0) for w in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "file_id int, worm_index int, timestamp int, turn int")
    got = as_dict(V.behaviour_statistics(df, ["file_id"], Track(), 10.0).collect(), "file_id")[0,]
    # A run's first row begins one row earlier, but not before the track.
    assert got["turn_inter_duration_50th"] == pytest.approx(0.9) and got["turn_intra_duration_50th"] == pytest.approx(3.0)
    assert got["turn_inter_frequency"] == 0 and got["turn_intra_frequency"] == pytest.approx(2 / 2 / 3.9)
