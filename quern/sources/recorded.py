"""Recorded calls in place of live ones: fetched pages, searches, completions, checkpoints, caches, prompts.

Live fetches, searches and models are no part of a plan that may be retried; what they returned is read from tables
keyed by the request."""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "struct<doc_id:string,pairs:array<struct<question:string,answer:string,quotes:array<string>,model_used:string>>>"


def fetched_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, html, html_static, status): recorded pages. A status of 400 or more, or none, is no page."""
    pages = spark.read.schema("url string, html string, html_static string, status int").parquet(path)
    good = F.coalesce(F.col("status"), F.lit(0)).between(1, 399)
    return pages.withColumn("html", F.when(good, F.col("html"))).withColumn("html_static", F.when(good, F.col("html_static")))


def joined_calls(requests: DataFrame, calls: DataFrame, key: str = "request_key") -> DataFrame:
    """``requests`` with what was recorded for their key; a request that was never made has nulls."""
    return requests.join(calls.dropDuplicates([key]), key, "left")


def parsed_completions(calls: DataFrame, schema: str, column: str = "text") -> DataFrame:
    """``calls`` with ``parsed``, the completion by its JSON schema, and ``failed``: whether it can't be read."""
    whole = F.try_parse_json(F.col(column)).isNotNull()
    return calls.withColumn("parsed", F.when(whole, F.from_json(F.col(column), schema))).withColumn("failed", F.col("parsed").isNull())


def text_completions(calls: DataFrame, column: str = "text") -> DataFrame:
    """``calls`` with the text, empty where the call failed."""
    return calls.withColumn(column, F.coalesce(F.col(column), F.lit("")))


def checkpoint_pairs(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(pairs, completed): the questions of a checkpoint of JSON lines, and the ids of all documents that it names,
    also of those without questions. Blank and unreadable lines are passed over."""
    parsed = lines.where(F.trim(column) != "").select(F.from_json(F.col(column), CHECKPOINT).alias("c")).where("c.doc_id is not null")
    pairs = parsed.select("c.doc_id", F.posexplode("c.pairs").alias("pair_no", "p")).select("doc_id", "pair_no", "p.*")
    return pairs, parsed.select("c.doc_id").distinct()


def read_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return checkpoint_pairs(spark.read.text(path))


def read_cache(spark: SparkSession, path: str, must_be_whole: bool = False) -> DataFrame:
    """The text of a cache file as one row; an unreadable file is an empty cache, or raises if it must be whole."""
    file = Path(path)
    text = file.read_text(encoding="utf-8") if file.exists() else "{}"
    try:
        json.loads(text)
    except ValueError:
        if must_be_whole:
            raise
        text = "{}"
    return spark.createDataFrame([(text,)], "value string")


@lru_cache(64)
def read_prompt(path: str) -> tuple[str, str]:
    """(system, user) of a prompt file with block texts under both names, stripped; read once."""
    parts: dict[str, list[str]] = {}
    name = None
    for line in Path(path).read_text(encoding="utf-8").split("\n"):
        if line[:1].strip() and not line.startswith("#") and ":" in line:
            name, _, rest = line.partition(":")
            parts[name.strip()] = [] if rest.strip() in ("|", ">", "|-", "") else [rest.strip()]
            name = name.strip()
        elif name:
            parts[name].append(line)

    def block(lines: list[str]) -> str:
        indent = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
        return "\n".join(x[indent:] for x in lines).strip()

    return block(parts.get("system", [])), block(parts.get("user", []))
