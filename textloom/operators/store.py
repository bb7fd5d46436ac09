"""Changes of stored index tables as whole-table expressions: insert-ignore, upserts, deletes.

Each returns the new table; the caller writes it (to a new path or partition),
so a lost executor or a retried job never leaves half a change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose keys are absent are added, one for each key."""
    fresh = new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh)


def add_counts(old: DataFrame, new: DataFrame, keys: Sequence[str], count: str = "frequency") -> DataFrame:
    """Counts of equal keys are added up."""
    return old.select(*keys, count).unionByName(new.select(*keys, count)).groupBy(*keys).agg(F.sum(count).alias(count))


def merge_postings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Frequencies add up, the newer tf wins, the larger importance stays."""
    # dealt out first: hardly a key repeats, so an aggregation before the exchange would only fill memory and spill
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1))).repartition("doc_id")
    return both.groupBy("term", "doc_id").agg(F.sum("frequency").alias("frequency"), F.max_by("tf", "__age").alias("tf"), F.max("importance").alias("importance"))


def replace_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` take the place of those with equal keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def delete_documents(old: DataFrame, ids: DataFrame) -> DataFrame:
    return old.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def reindex(old: DataFrame, new: DataFrame) -> DataFrame:
    """Index rows of documents that come again are replaced whole, so indexing twice equals indexing once."""
    return delete_documents(old, new).unionByName(new)


def refresh_statistics(spark: SparkSession, names: Sequence[str]) -> None:
    """Statistics of saved tables, for the optimizer."""
    for name in names:
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")


def stamped(docs: DataFrame) -> DataFrame:
    """``last_indexed`` set to now."""
    return docs.withColumn("last_indexed", F.current_timestamp())
