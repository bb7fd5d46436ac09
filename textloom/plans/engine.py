"""The search engine: index tables built once, queries as DataFrame plans over them."""

from __future__ import annotations

import math
import re
import time
from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.snippets import description_column, snippet_column
from ..functions.stem import porter
from ..functions.stop_words import FALLBACK, QUERY
from ..functions.text import tidy_description
from ..operators import boolean, graph, index, phrase, relevance
from ..shipping import ship
from .parser import ParsedQuery, normalize_operators, parse_query, query_terms

CACHED_QUERIES = 500
MAX_RESULTS = 1000


@dataclass
class SearchEngine:
    """``docs``: doc_id, url, title, text and, for raw pages, elements and first_paragraph."""

    docs: DataFrame
    stop: Sequence[str] = tuple(FALLBACK)
    query_stop: Sequence[str] = tuple(QUERY)
    stem: bool = True
    parts: bool = True
    #: look phrases up by their unstemmed first word, as a stemmed index then often cannot answer
    strict: bool = False

    def __post_init__(self) -> None:
        ship(self.docs.sparkSession)
        self._cache: OrderedDict[str, dict] = OrderedDict()
        self._narrow: dict[tuple[str, ...], tuple[DataFrame, DataFrame, DataFrame]] = {}

    @property
    def from_html(self) -> bool:
        return "elements" in self.docs.columns

    @cached_property
    def tokens(self) -> DataFrame:
        if self.from_html:
            return index.html_tokens(self.docs, self.stop, self.parts, self.stem)
        return index.text_tokens(self.docs, self.stop, self.parts, self.stem)

    @cached_property
    def lengths(self) -> DataFrame:
        return index.doc_lengths(self.docs, parts=self.parts).persist()

    @cached_property
    def postings(self) -> DataFrame:
        return index.postings(self.tokens, self.lengths).persist()

    @cached_property
    def stats(self) -> DataFrame:
        return index.term_stats(self.postings, index.count_documents(self.docs)).persist()

    def _tables(self, terms: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Postings and statistics of these terms, and all lengths: of the index if that was built, else of the terms alone, stored.

        One query needs a few terms of every text, and an index of all of them
        costs far more than the query.
        """
        if "postings" in self.__dict__:
            return self.postings, self.stats, self.lengths
        key = tuple(sorted(set(terms)))
        if key not in self._narrow:
            if self.from_html:
                tokens = self.tokens.where(F.col("term").isin(*key))
                post, lengths = graph.stored(index.postings(tokens, None).withColumn("tf", F.lit(None).cast("double"))), self.lengths
            else:
                rows = graph.stored(index.forward(self.docs, self.stop, self.parts, self.stem, only=key))
                post, lengths = index.forward_postings(rows, index.unrepeated(self.docs)).drop("n_terms"), rows.select("doc_id", "n_terms")
            if len(self._narrow) >= CACHED_QUERIES:
                self._narrow.pop(next(iter(self._narrow)))
            self._narrow[key] = post, index.term_stats(post, index.count_documents(self.docs)), lengths
        return self._narrow[key]

    @property
    def form(self) -> Callable[[str], str]:
        """How a query's word looks in the index."""
        return porter if self.stem and not self.strict else str

    def metrics(self) -> DataFrame:
        return index.metrics(self.postings, self.stats, self.lengths)

    def nested_index(self) -> DataFrame:
        return index.nested_index(self.tokens, self.docs)

    def flat_index(self) -> DataFrame:
        return index.flat_index(self.postings)

    def index_stats(self) -> DataFrame:
        return index.index_stats(self.postings, self.docs)

    def link_stats(self) -> DataFrame:
        return graph.link_stats(graph.relations(graph.extract_links(self.docs), self.docs))

    def release(self) -> None:
        """Give up the cached tables."""
        for name in ("lengths", "postings", "stats"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()
        self._cache.clear()
        self._narrow.clear()

    def analyze(self, query: str) -> ParsedQuery:
        return parse_query(normalize_operators(query.strip()), self.query_stop, self.stem)

    def scored(self, q: ParsedQuery) -> DataFrame:
        """``doc_id, score`` of every match, no order, no cap."""
        empty = self.docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
        if q.kind == "keyword" and q.terms:
            post, stats, _ = self._tables(q.terms)
            matches = boolean.relaxed(post, q.terms)
            score = relevance.live(self.docs, post, stats, q.terms, matches)
            near = relevance.proximity(self.docs.join(matches, "doc_id", "left_semi"), q.terms)
            return score.join(near, "doc_id").select("doc_id", (F.col("score") + F.col("bonus")).alias("score"))
        if q.kind == "phrase" and q.phrases[0].strip():
            words = q.phrases[0].lower().split()
            post = self._tables([self.form(w) for w in words])[0]
            found = phrase.literal(self.docs, post, q.phrases[0], self.query_stop, form=self.form)
            first = F.col("first_paragraph") if "first_paragraph" in self.docs.columns else None
            found = relevance.drop_product_pages(found, words)
            return found.select("doc_id", phrase.literal_score(q.phrases[0], first).alias("score"))
        if q.kind == "boolean" and len(q.phrases) > 1:
            post, stats, _ = self._tables([self.form(w) for p in q.phrases for w in p.lower().split()])
            matches = phrase.combine(self.docs, post, q.phrases, q.operator or "AND", self.query_stop, self.form)
            got = phrase.combined_score(matches, self.docs, post, stats, q.phrases, self.query_stop, self.form)
            kept = relevance.drop_product_pages(self.docs, [w for p in q.phrases for w in p.split()])
            return got.join(kept, "doc_id", "left_semi")
        return empty

    def page(self, q: ParsedQuery, page: int = 1, size: int = 25) -> DataFrame:
        """``doc_id, url, title, score, snippet, description`` of one page; text work is for that page only."""
        rows = index.page_slice(self.scored(q), page, size).join(self.docs, "doc_id")
        # the query's own words, since a stem is no word of the text to mark
        terms = list(query_terms(q.original, self.query_stop, False)) if q.kind == "keyword" else [w for p in q.phrases for w in p.lower().split()]
        snippet = snippet_column(F.col("text"), terms, q.phrases[0] if q.kind == "phrase" else None)
        paragraphs = F.transform(F.filter("elements", lambda e: e["tag"] == "p"), lambda e: e["text"]) if self.from_html else F.array(F.col("text"))
        shown = rows.select("doc_id", "url", "title", "score", snippet.alias("snippet"), tidy_description(description_column(paragraphs, "text")).alias("description"))
        return shown.orderBy(F.col("score").desc(), "doc_id")

    def suggestions(self, query: str, results: DataFrame, k: int = 5) -> list[str]:
        """The query with a title word of the best five results added, and with its first word replaced; in order of text."""
        low, listed = query.lower(), set(self.query_stop)
        out: set[str] = set()
        for r in results.orderBy(F.col("score").desc(), "doc_id").limit(5).select("title").collect():
            for w in (r.title or "").lower().split():
                if len(w) > 3 and w not in listed and w not in low:
                    out.add(f"{low} {w}")
                    if " " in low:
                        out.add(f"{w} {low.split(None, 1)[1]}")
        return sorted(out)[:k]

    def search(self, query: str, page: int = 1, page_size: int = 25) -> dict:
        """One page of results and what a client shows with it; pages are cached by query, number and size."""
        began = time.time()
        q = self.analyze(query)
        key = f"{q.original}\0{page}\0{page_size}"
        if key in self._cache:
            self._cache.move_to_end(key)
            return self._cache[key] | {"fromCache": True}
        out: dict = {"query": query, "displayQuery": q.original, "kind": q.kind, "operator": q.operator, "isPhraseSearch": q.kind == "phrase", "page": page, "pageSize": page_size, "error": q.error, "fromCache": False}
        if q.kind == "error":
            return out | {"results": [], "totalResults": 0, "totalPages": 0, "searchTime": 0}
        total = min(self.scored(q).count(), MAX_RESULTS)
        shown = self.page(q, page, page_size)
        out |= {"results": [r.asDict() for r in shown.collect()], "totalResults": total, "totalPages": math.ceil(total / page_size)}
        out["searchTime"] = round(1000 * (time.time() - began))
        self._cache[key] = out
        if len(self._cache) > CACHED_QUERIES:
            self._cache.popitem(last=False)
        return out

    def total(self, query: str) -> int:
        """How many documents a query has, capped as pages are."""
        return min(self.scored(self.analyze(query)).count(), MAX_RESULTS)

    def build_index(self) -> DataFrame:
        """Build and keep the index tables; the postings."""
        self.postings.count()
        self.stats.count()
        return self.postings

    compute_metrics = metrics

    def reindex(self, fresh: DataFrame) -> SearchEngine:
        """An engine over the documents with those of ``fresh`` replaced or added, by url."""
        columns = self.docs.columns
        merged = self.docs.join(fresh.select("url"), "url", "left_anti").select(*columns).unionByName(fresh.select(*columns))
        return SearchEngine(merged, self.stop, self.query_stop, self.stem, self.parts, self.strict)

    def mixed_boolean(self, query: str) -> DataFrame:
        """``doc_id`` of two parts around an operator, quoted or not."""
        found = re.split(r"\b(AND|OR|NOT)\b", normalize_operators(query), maxsplit=1)
        if len(found) < 3:
            return self.scored(self.analyze(query)).select("doc_id")
        sides = [(p.strip().strip('"'), p.strip().startswith('"')) for p in (found[0], found[2])]
        post = self._tables([self.form(w) for text, _ in sides for w in text.lower().split()])[0]
        return phrase.mixed(self.docs, post, sides, found[1], self.query_stop, self.form)

    def ranked_page(self, terms: Sequence[str], ranks: DataFrame, page: int = 1, size: int = 10) -> DataFrame:
        """``position, doc_id, url, title, score, snippet`` of a page of ``rank_all``, one row a url."""
        best = index.page_slice(self.rank_all(terms, ranks), page, size).join(self.docs, "doc_id")
        one = index.first_per_url(best)
        numbered = one.withColumn("position", F.row_number().over(Window.orderBy(F.col("score").desc(), "doc_id")) + (page - 1) * size)
        return numbered.select("position", "doc_id", "url", "title", "score", snippet_column(F.col("text"), terms).alias("snippet")).orderBy("position")

    def rank_all(self, terms: Sequence[str], ranks: DataFrame) -> DataFrame:
        """Every document by relevance, link rank and density together."""
        names = [*terms, *(t.strip('"').lower() for t in terms)]
        post, stats, lengths = (self.postings, self.stats, self.lengths) if self.from_html else self._tables(names)
        rel = relevance.weighted_tfidf(post, stats, terms)
        rel = relevance.url_boosts(rel, self.docs, post, terms)
        return relevance.blend(rel, ranks, relevance.density(post, lengths, terms))


def as_text(found: dict) -> str:
    """A search's answer as lines of text."""
    lines = [f"{found['query']}: {found['totalResults']} results" if not found.get("error") else f"{found['query']}: {found['error']}"]
    lines += [f"{i}. {r['title']} <{r['url']}> {r['score']:.4f}" for i, r in enumerate(found["results"], 1)]
    return "\n".join(lines)
