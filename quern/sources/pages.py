"""Lists and configurations of the pages to read, and texts given by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.identity import content_hash, doc_id
from quern.functions.text import not_blank, path_part, strip
from quern.functions.urls import is_tool_url

_PAGE = "url:string,category:string,label:string,cell:string,cell_name:string"
#: Both shapes of a configuration: one institution with pages, or institutions of a country and layer.
CONFIG = f"struct<institution:string,short_name:string,country:string,layer:string,pages:array<struct<{_PAGE}>>,institutions:array<struct<institution:string,short_name:string,pages:array<struct<{_PAGE}>>>>>"


def url_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(url): the addresses of a text file, one a line; blank lines and lines that begin with # are left out."""
    return lines.select(strip(F.col(column)).alias("url")).where("url != '' and not startswith(url, '#')")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    return url_lines(spark.read.text(path))


def url_csv(spark: SparkSession, path: str, suspect_only: bool = False) -> DataFrame:
    """(city, url): a CSV file with a head; with ``suspect_only`` the rows whose column suspect is exactly yes."""
    rows = spark.read.option("header", True).csv(path)
    if suspect_only:
        rows = rows.where(F.col("suspect") == "yes") if "suspect" in rows.columns else rows.where("false")
    return rows.select("city", "url")


def config_pages(configs: DataFrame, column: str = "value") -> DataFrame:
    """(url, institution, short_name, category, label, cell, country, layer, corpus): the pages of configurations,
    each a JSON text of either shape; the presence of institutions decides which. The name of a cell goes before the
    category. An unreadable configuration has no pages; configurations without country or layer have no corpus."""
    parsed = configs.select(F.from_json(F.col(column), CONFIG).alias("c"))
    one = F.array(F.struct(F.col("c.institution").alias("institution"), F.col("c.short_name").alias("short_name"), F.col("c.pages").alias("pages")))
    nested = parsed.select("c.country", "c.layer", F.explode(F.coalesce("c.institutions", one)).alias("i"))
    rows = nested.select("country", "layer", "i.institution", "i.short_name", F.explode("i.pages").alias("p"))
    corpus = F.when(F.col("country").isNotNull() & F.col("layer").isNotNull(), F.concat(path_part(F.col("country")), F.lit("_"), path_part(F.col("layer")), F.lit("_corpus")))
    return rows.select(
        "p.url", "institution", "short_name", F.coalesce(not_blank(F.col("p.cell_name")), F.col("p.category"), F.lit("")).alias("category"), F.coalesce("p.label", F.lit("")).alias("label"), "p.cell", "country", "layer", corpus.alias("corpus")
    )


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the configuration files under ``path``, one JSON document a file."""
    return config_pages(spark.read.text(path, wholetext=True))


def url_metadata(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """``urls`` (url) with the metadata of the first configured page of that address, in the order of corpus and
    institution; addresses that no configuration names have empty metadata."""
    fields = ["institution", "short_name", "category", "label", "corpus"]
    first = pages.groupBy("url").agg(F.min(F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in ["corpus", "institution", "short_name", "category", "label"]))).alias("_m"))
    joined = urls.join(first, "url", "left")
    return joined.select("url", *(F.coalesce(F.col(f"_m.{c}"), F.lit("")).alias(c) for c in fields))


def without_tool_pages(urls: DataFrame, url: str = "url") -> DataFrame:
    return urls.where(~is_tool_url(F.col(url)))


def manual_documents(texts: DataFrame, uri: Column, title: Column, text: str = "value") -> DataFrame:
    """Documents from texts given by hand, marked as such in their open metadata; blank texts give none."""
    body = strip(F.col(text))
    extra = F.to_json(F.struct(F.lit(True).alias("manual_insert")))
    rows = texts.where(body != "").select(doc_id(uri).alias("doc_id"), F.lit("web").alias("source_type"), uri.alias("source_uri"), F.coalesce(title, F.lit("")).alias("title"), content_hash(body).alias("content_hash"), extra.alias("extra_json"), body.alias("full_text"))
    return rows


def read_manual_text(spark: SparkSession, path: str, uri: str, title: str = "") -> DataFrame:
    return manual_documents(spark.read.text(path, wholetext=True), F.lit(uri), F.lit(title))
