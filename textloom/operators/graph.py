"""Links, link statistics, two variants of PageRank, and frontier expansion."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.url import normalize_url, resolve_url, short_url
from ..shipping import ship


#: Sum of all changes of a round, of ranks that sum to 1 at most, under which the rest of them lies within rounding: each further round moves 0.85 of it.
STILL = 1e-15


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through ``spark.checkpoint.dir``; a folder of our own only where that is unset and all is one process."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the folder of ``cut``: a fifth of a checkpoint's bytes, and a reader takes only its columns."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
        folder = str(spark.sparkContext.getCheckpointDir())
    path = f"{folder.rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def extract_links(pages: DataFrame) -> DataFrame:
    """``parent_url, child_url`` of parsed pages: resolved, normalised, fragments-only and empty hrefs dropped."""
    ship(pages.sparkSession)
    links = pages.select(F.col("url").alias("parent_url"), F.explode("hrefs").alias("href")).where("href != '' AND NOT startswith(href, '#')")
    links = links.withColumn("child_url", normalize_url(resolve_url("parent_url", "href"))).where("child_url IS NOT NULL")
    return links.select("parent_url", short_url(F.col("child_url")).alias("child_url")).distinct()


def relations(links: DataFrame, docs: DataFrame) -> DataFrame:
    """``src, dst`` ids of links whose both ends are stored."""
    d = docs.select("doc_id", "url")
    out = links.join(d.select(F.col("doc_id").alias("src"), F.col("url").alias("parent_url")), "parent_url")
    return out.join(d.select(F.col("doc_id").alias("dst"), F.col("url").alias("child_url")), "child_url").select("src", "dst").distinct()


def relations_below(edges: DataFrame, limit: int | None = 6000) -> DataFrame:
    """Edges between ids below a bound, if any: a dense matrix's cells, without the matrix."""
    if limit is None:
        return edges
    return edges.where((F.col("src") < limit) & (F.col("dst") < limit))


def link_stats(edges: DataFrame) -> DataFrame:
    """Parents, relationships, average and largest number of children, and the parent with most."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return out.agg(
        F.count(F.lit(1)).alias("n_parents"), F.sum("n").alias("n_relationships"), F.avg("n").alias("avg_children"), F.max("n").alias("max_children"),
        F.max_by("src", F.struct("n", -F.col("src"))).alias("max_parent"),
    )


def top_parents(edges: DataFrame, k: int = 10) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("n_children")).orderBy(F.col("n_children").desc(), "src").limit(k)


def page_rank(nodes: DataFrame, edges: DataFrame, scaled: bool = True, iterations: int = 100, tolerance: float | None = 1e-4, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """``id, rank`` from 1/N each; nodes without links lose their mass.

    ``scaled``: the teleport part is the present sum of ranks over N, and the run
    ends when the length of the rank vector moves by ``tolerance`` or less; else
    it is a constant 1/N and the number of iterations is fixed, though the rounds
    after one that moves no rank, as far as doubles tell, need not be computed.
    """
    spark = nodes.sparkSession
    nodes = cut(nodes.select(F.col("id").cast("long")).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    # one row a source: what meets the ranks anew in every round is a third of the edges' bytes
    weights = stored(edges.groupBy("src").agg((F.lit(damping) / F.count(F.lit(1))).alias("w"), F.collect_list("dst").alias("dsts")).where("src IS NOT NULL"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    length = (1.0 / n) ** 0.5
    del spark
    for step in range(1, iterations + 1):
        flow = weights.join(ranks, weights["src"] == ranks["id"]).select((F.col("w") * F.col("rank")).alias("part"), F.explode("dsts").alias("dst")).groupBy("dst").agg(F.sum("part").alias("in"))
        total = ranks.agg(F.sum("rank").alias("total")) if scaled else None
        base = ranks.withColumnRenamed("rank", "__before").join(flow, F.col("id") == flow["dst"], "left")
        teleport = F.lit((1 - damping) / n)
        if total is not None:
            base, teleport = base.join(F.broadcast(total)), teleport * F.col("total")
        ranks = base.select("id", (F.coalesce("in", F.lit(0.0)) + teleport).alias("rank"), "__before")
        check = scaled and tolerance is not None
        if check or step % cut_every == 0:
            ranks = cut(ranks)
            if not scaled and step < iterations:
                moved = ranks.agg(F.sum(F.abs(F.col("rank") - F.col("__before")))).first()[0]
                if moved <= STILL:
                    return ranks.drop("__before")
        ranks = ranks.drop("__before")
        if check:
            new = float(ranks.agg(F.sqrt(F.sum(F.col("rank") * F.col("rank")))).first()[0])
            if abs(new - length) <= tolerance:
                break
            length = new
    return ranks


def expand_frontier(seeds: DataFrame, links: DataFrame, limit: int = 6000, depth: int = 50) -> DataFrame:
    """``url, level`` reached from the seeds by stored links, level by level, until ``limit`` urls.

    A level that would pass the limit is cut in order of url.
    """
    seen = cut(seeds.select("url").distinct().orderBy("url").limit(limit).withColumn("level", F.lit(0)))
    n = seen.count()
    for level in range(1, depth + 1):
        front = seen.where(F.col("level") == level - 1)
        new = links.join(front, links["parent_url"] == front["url"], "left_semi").select(F.col("child_url").alias("url")).distinct().join(seen, "url", "left_anti")
        seen = cut(seen.unionByName(new.orderBy("url").limit(limit - n).withColumn("level", F.lit(level))))
        m = seen.count()
        if m == n or m >= limit:
            break
        n = m
    return seen
