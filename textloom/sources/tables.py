"""Readers: stored tables, seed lists, robots rules, and the document view of the plain-text corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.html import html_extract, html_hrefs
from ..shipping import ship

# Where a crawl starts without a seed list is up to the caller.
EMPTY_SEEDS: tuple[str, ...] = ()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out anew where a table has fewer splits than the cluster has cores.

    Tokenising and parsing cost far more than reading, and a small file may be one
    split; a large table has splits enough and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, url, title, text`` of the plain-text corpus: first line as title, url from the source."""
    return spread(table(spark, folder, "documents").select("doc_id", "text", "source")).select(
        "doc_id",
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        "text",
    )


def html_documents(pages: DataFrame) -> DataFrame:
    """``doc_id, url, title, text, elements, hrefs, ...`` of raw pages, each parsed once."""
    ship(pages.sparkSession)
    parsed = spread(pages.where(F.col("url").isNotNull() & F.col("html").isNotNull()).select("page_id", "url", "html")).select(F.col("page_id").alias("doc_id"), "url", "html", html_extract("html").alias("x"))
    return parsed.select("doc_id", "url", "x.title", "x.text", "x.code", "x.description", "x.first_paragraph", "x.elements", "x.hrefs", "html")


def html_links(pages: DataFrame) -> DataFrame:
    """``doc_id, url, hrefs`` of raw pages, as ``html_documents`` has them; only the hrefs come back from the parser."""
    ship(pages.sparkSession)
    kept = spread(pages.where(F.col("url").isNotNull() & F.col("html").isNotNull()).select("page_id", "url", "html"))
    return kept.select(F.col("page_id").alias("doc_id"), "url", html_hrefs("html").alias("hrefs"))


def seed_urls(spark: SparkSession, path: str) -> DataFrame:
    """One url a line, trimmed, blanks skipped."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url != ''")


def robots_rules(lines: DataFrame, host: str = "host", number: str = "line_no", text: str = "value") -> DataFrame:
    """``host, prefix`` of the Disallow lines in the block for every agent; one file's lines are one partition."""
    low = F.lower(F.trim(text))
    agent = F.when(low.startswith("user-agent:"), F.trim(F.substring(low, F.lit(12), F.length(low))))
    inside = F.last(agent, ignorenulls=True).over(Window.partitionBy(host).orderBy(number))
    rules = lines.withColumn("__agent", inside).where((F.col("__agent") == "*") & low.startswith("disallow:"))
    return rules.select(host, F.trim(F.substring(F.trim(text), F.lit(10), F.length(text))).alias("prefix")).where("prefix != ''").distinct()


def allowed_by_robots(urls: DataFrame, rules: DataFrame, url: str = "url", host: Column | None = None) -> DataFrame:
    """Urls that no rule of their host excludes; an equi join on the host, then the prefix."""
    at = host if host is not None else F.regexp_extract(F.lower(url), r"^[a-z]+://([^/?#:]*)", 1)
    path = F.regexp_replace(F.col(url), r"^[A-Za-z]+://[^/?#]*", "")
    rest = rules.select(F.col("host").alias("__h"), "prefix")
    keyed = urls.withColumn("__host", at).withColumn("__path", path)
    return keyed.join(rest, (keyed["__host"] == rest["__h"]) & F.col("__path").startswith(F.col("prefix")), "left_anti").drop("__host", "__path")
