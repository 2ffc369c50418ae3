"""From the command line: ``python -m trackloom run FOLDER`` and ``python -m trackloom SERIES OUTPUT``.

The first runs the steps from frames to series in a folder of tables (``plans.route``).  The second reads assembled series
(Parquet, with file_id), cuts time windows, and writes summaries as a pair of CSVs for each window.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trackloom.operators import levels, selection
from trackloom.plans.route import run_folder
from trackloom.plans.stages import Parameters
from trackloom.sources.export import write_csv_pair
from trackloom.sources.ingest import read_table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trackloom", description=__doc__)
    p.add_argument("series", help="folder of assembled series")
    p.add_argument("output", help="folder for the CSVs")
    p.add_argument("--level", default="plate", choices=["plate", "trajectory", "plate_augmented"])
    p.add_argument("--fps", type=float, default=25.0)
    p.add_argument("--windows", default="", help="a:b, a:end or a:b:step, separated by commas; all if empty")
    p.add_argument("--unit", default="frame_numbers", choices=["frame_numbers", "seconds"])
    p.add_argument("--include", default="", help="keywords of which a statistic's name must hold one")
    p.add_argument("--exclude", default="", help="keywords that no statistic's name may hold")
    p.add_argument("--folds", type=int, default=5)
    return p


def steps_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trackloom run", description="Runs the steps from frames to series.")
    p.add_argument("folder", help="folder with the tables frames and meta, which gets the others")
    p.add_argument("--start", default="", help="first step; its inputs must be there")
    p.add_argument("--end", default="", help="last step")
    p.add_argument("--parameters", default="", help="JSON of parameters")
    p.add_argument("--light", action="store_true", help="animals are lighter than their background")
    return p


def run_steps(args: Sequence[str], spark: SparkSession | None = None) -> list[str]:
    given = steps_parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("trackloom").getOrCreate()
    return run_folder(spark, given.folder, Parameters.of(given.parameters), given.start, given.end, not given.light)


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> list:
    """The tables that were written by "run", else the pairs of CSVs."""
    args = list(sys.argv[1:] if args is None else args)
    if args[:1] == ["run"]:
        return run_steps(args[1:], spark)
    given = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("trackloom").getOrCreate()
    series = read_table(spark, given.series)
    windows = selection.windows_table(spark, given.windows, given.unit, given.fps)
    names = selection.select_features(levels.statistic_names(series.columns), None, given.include, given.exclude)
    rows = selection.in_windows(series, windows).drop("start", "end")
    keys = ["window_id", "file_id"]
    if given.level == "trajectory":
        summary, info = levels.trajectory_summary(rows, keys, given.fps)
        keys = [*keys, "worm_index"]
        table = info.join(levels.wide(summary, keys, names), keys)
    elif given.level == "plate_augmented":
        table = levels.wide(levels.fold_summary(rows, keys, given.fps, n_folds=given.folds), [*keys, "i_fold"], names)
    else:
        well = ["well_name"] if "well_name" in rows.columns else []
        table = levels.wide(levels.plate_summary(rows, keys, given.fps), [*keys, *well], names)
    table = table.persist()
    files, out = series.select("file_id").distinct(), []
    for k in range(windows.count()):
        part = table.where(F.col("window_id") == k).drop("window_id")
        good = files.join(part.select("file_id").distinct().withColumn("is_good", F.lit(True)), "file_id", "left").na.fill(False)
        out.append(write_csv_pair(part, good, given.output, "current", given.level, k))
    table.unpersist()
    return out


if __name__ == "__main__":
    main()
