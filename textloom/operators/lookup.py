"""Point lookups: selections, projections and counts that prune columns and push their filters down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_url(docs: DataFrame, url: str) -> DataFrame:
    return docs.where(F.col("url") == url)


def by_status(docs: DataFrame, status: str) -> DataFrame:
    return docs.where(F.col("status") == status)


def existing(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidate urls that are stored; none is read twice."""
    return candidates.join(docs.select("url"), "url", "left_semi")


def by_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def document_data(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Id, url and title, and the text only if it is wanted."""
    return docs.select("doc_id", "url", "title", *(["text"] if with_text else []))


def by_terms(table: DataFrame, terms: Sequence[str]) -> DataFrame:
    return table.where(F.col("term").isin(*terms))


def posting_list(post: DataFrame, term: str, limit: int | None = None) -> DataFrame:
    """A term's documents; a cap counts in order of id."""
    out = post.where(F.col("term") == term).select("doc_id", "frequency")
    return out.orderBy("doc_id").limit(limit) if limit else out


def frequency_in(post: DataFrame, pairs: DataFrame) -> DataFrame:
    """``frequency`` of each (term, doc_id) asked for; 0 where there is none."""
    return pairs.join(post.select("term", "doc_id", "frequency"), ["term", "doc_id"], "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))


def positions_of(tokens: DataFrame, term: str, doc_id: int | None = None, tag: str | None = None) -> DataFrame:
    """Places of a term, in order; narrowed to a document or a field if given."""
    out = tokens.where(F.col("term") == term)
    out = out.where(F.col("doc_id") == doc_id) if doc_id is not None else out
    out = out.where(F.col("tag") == tag) if tag is not None else out
    return out.orderBy("doc_id", "element_no", "position")


def at_position(tokens: DataFrame, doc_id: int, position: int) -> DataFrame:
    return tokens.where((F.col("doc_id") == doc_id) & (F.col("position") == position))


def of_document(table: DataFrame, doc_id: int, tag: str | None = None) -> DataFrame:
    out = table.where(F.col("doc_id") == doc_id)
    return out.where(F.col("tag") == tag) if tag else out


def consecutive(tokens: DataFrame, doc_id: int, terms: Sequence[str]) -> DataFrame:
    """Places of several terms in a document, in order."""
    return tokens.where((F.col("doc_id") == doc_id) & F.col("term").isin(*terms)).orderBy("element_no", "position")


def idf_pairs(stats: DataFrame, name: str = "idf_smooth") -> DataFrame:
    return stats.select("term", F.col(name).alias("idf"))


def length_array(lengths: DataFrame) -> DataFrame:
    """Lengths in order of id as one array; for small collections only."""
    return lengths.agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "n_terms"))), lambda x: x["n_terms"]).alias("lengths"))
