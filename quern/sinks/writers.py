"""Writers. Each task writes its own part; Spark's commit makes a table appear whole or not at all."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """Rejected questions, checkpoints: one JSON object a line."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_log(df: DataFrame, path: str) -> None:
    """Skipped questions: tab-separated lines, appended."""
    df.write.mode("append").option("sep", "\t").csv(path)


def write_cells(df: DataFrame, path: str, by: str = "sheet", order: list[str] | None = None) -> None:
    """One folder for each cell; rows are sorted inside of each task's part, and a cell may have several parts."""
    out = df.sortWithinPartitions(by, *order) if order else df
    out.write.mode("overwrite").partitionBy(by).option("header", True).csv(path)


def write_keyed(df: DataFrame, path: str) -> None:
    """An append-only cache; readers take one entry a key."""
    df.write.mode("append").parquet(path)


def write_text_files(df: DataFrame, folder: str, name: str = "file_name", body: str = "body") -> DataFrame:
    """(written): each row as a text file under ``folder``, which all executors must share; returns the number of
    files of each batch, lazily, so the write happens with the action. Rows without name are left out, and a file is
    replaced in one step, so a retried task leaves no half file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for frame in frames:
            for file, text in zip(frame["name"], frame["body"]):
                path = os.path.join(folder, os.path.basename(file))
                with open(f"{path}.{os.getpid()}.part", "w", encoding="utf-8") as f:
                    f.write(text or "")
                os.replace(f.name, path)
            yield pd.DataFrame({"written": [len(frame)]})

    return df.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), F.col(body).alias("body")).mapInPandas(run, "written long")


def replace_table(df: DataFrame, path: str) -> None:
    """A table that replaces one that it was made from: written beside it, then swapped by the caller's file system
    (here by writing to the next numbered folder and naming it in ``_current``)."""
    spark = df.sparkSession
    no = current_number(path) + 1
    df.write.mode("overwrite").parquet(f"{path}/v{no}")
    spark.createDataFrame([(no,)], "no int").coalesce(1).write.mode("overwrite").json(f"{path}/_current/{no}")


def current_number(path: str) -> int:
    """The number of the newest complete version of a table of ``replace_table``; 0 before the first."""
    folder = os.path.join(path, "_current")
    done = [int(x) for x in os.listdir(folder) if x.isdigit() and os.path.exists(os.path.join(folder, x, "_SUCCESS"))] if os.path.isdir(folder) else []
    return max(done, default=0)


def read_current(spark, path: str, schema: str) -> DataFrame:
    no = current_number(path)
    return spark.read.parquet(f"{path}/v{no}") if no else spark.createDataFrame([], schema)
