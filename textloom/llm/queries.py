"""The registered queries of this subpackage, thin layers over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, license_scan, lm, ngram_join, packing, quality_rules, rule_classifier, substring_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.quality_votes(_table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("is_good")).alias("kept"), "quality",
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.class_links(_table(spark, sf_dir, "documents"), 4, 85)


URL_RULES = (
    url_filter.UrlRule("allow", "com", "/"),
    url_filter.UrlRule("block", "example.com", "/en/"),
    url_filter.UrlRule("allow", "www.example.com", "/en/"),
    url_filter.UrlRule("block", "net", "/es/"),
    url_filter.UrlRule("block", "net", "/fr/"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES).withColumn("purity", F.round("purity", 9))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), 20)
    return done.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2("__kept", 256).alias("kept_sha256"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return chat.read_back(chat.expand(turns.unionByName(extra)))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"), "crc32(cast(doc_id AS string)) % 7 = 2")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = rule_classifier.train(docs, _table(spark, sf_dir, "labels").where(~held))
    scored = rule_classifier.with_score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_license_scan": op2_license_scan,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_url_filter": op4_url_filter,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_quality_classifier": op10_quality_classifier,
}

_TURN_SIZE = (
    "length(t) + len(regexp_extract_all(t, '[<\\[]\\\\*/?(?:s>|INST\\]|ROLE\\])')) + "
    "CASE r WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 19 + length(r) END"
)



def _url_sql(depth: int = 4) -> str:
    """The tree of ``url_filter.judge`` level by level, with its default parameters."""
    fits = [(r, f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))") for r in sorted(URL_RULES, key=lambda r: -len(r.text))]
    case = lambda pick: "CASE " + " ".join(f"WHEN {c} THEN '{pick(r)}'" for r, c in fits) + " END"
    bare = "regexp_replace(coalesce(url, ''), '^.*?://', '', 's')"
    lexical = (
        "CASE WHEN regexp_matches(x, '^[0-9]+$') THEN '{n}' WHEN regexp_matches(x, '^[0-9]+\\.[A-Za-z0-9]{1,5}$') THEN concat('{n}', regexp_extract(x, '(\\.[A-Za-z0-9]+)$', 1)) "
        "WHEN regexp_matches(x, '^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$') THEN '{date}' WHEN regexp_matches(x, '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$') THEN '{uuid}' WHEN regexp_matches(x, '^[0-9a-fA-F]{12,}$') THEN '{hex}' ELSE x END"
    )
    levels = ["t0 AS (SELECT *, '' AS node FROM shapes)"]
    for k in range(1, depth + 1):
        levels += [
            f"n{k} AS (SELECT *, coalesce(segs[{k}], '') AS name FROM t{k - 1})",
            f"f{k} AS (SELECT host, node, count(*) AS fan, sum(m) AS paths FROM (SELECT host, node, name, count(*) AS m FROM n{k} GROUP BY host, node, name) GROUP BY host, node)",
            f"t{k} AS (SELECT n.host, shape, segs, labelled, blocked, CASE WHEN name = '' THEN n.node ELSE concat(n.node, '/', CASE WHEN fan >= 8 AND fan > 0.5 * paths AND NOT starts_with(name, '{{') THEN '{{*}}' ELSE name END) END AS node FROM n{k} n JOIN f{k} f ON n.host = f.host AND n.node = f.node)",
        ]
    other_n, other_b = "(pn - n)", "(pb - b)"
    pooled = "(pb * 1.0 / greatest(pn, 1))"
    gap = f"abs(b * 1.0 / greatest(n, 1) - {other_b} * 1.0 / greatest({other_n}, 1))"
    spread = f"sqrt({pooled} * (1 - {pooled}) * (1.0 / greatest(n, 1) + 1.0 / greatest({other_n}, 1)))"
    merges = ["m0 AS MATERIALIZED (SELECT host, names, CAST(n AS BIGINT) AS n, CAST(b AS BIGINT) AS b, '' AS node, p0 AS e FROM leaf, prior)"]
    for k in range(1, depth + 2):
        merges += [
            f"a{k} AS MATERIALIZED (SELECT *, CASE WHEN len(names) >= {k - 1} THEN coalesce(names[{k}], '') END AS name FROM m{k - 1})",
            f"b{k} AS MATERIALIZED (SELECT host, node, name, CAST(sum(n) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS b FROM a{k} WHERE name IS NOT NULL GROUP BY host, node, name)",
            f"o{k} AS (SELECT host, node, CAST(sum(n) AS BIGINT) AS pn, CAST(sum(b) AS BIGINT) AS pb, count(*) AS kids, count(*) FILTER (WHERE n > 0) AS known, sum(CASE WHEN n > 0 THEN b * 1.0 / n ELSE 0.0 END) AS shares FROM b{k} GROUP BY host, node)",
            f"s{k} AS MATERIALIZED (SELECT b{k}.host, b{k}.node, name, kids, known, shares, CASE WHEN name = '' THEN '' WHEN n = 0 THEN '/{{unlabelled}}' WHEN {other_n} > 0 AND {gap} <= 1.96 * {spread} THEN '/{{**}}' ELSE concat('/', name) END AS step FROM b{k} JOIN o{k} ON b{k}.host = o{k}.host AND b{k}.node = o{k}.node)",
            f"m{k} AS MATERIALIZED (SELECT a.host, names, n, b, concat(a.node, coalesce(step, '')) AS node, coalesce((shares + (4 + kids - known) * e) / (kids + 4), e) AS e FROM a{k} a LEFT JOIN s{k} s ON a.host = s.host AND a.node = s.node AND a.name = s.name)",
        ]
    return (
        f"WITH h AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN translate(regexp_extract({bare}, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') ELSE '' END AS host, "
        f"CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract({bare}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages), "
        f"base AS (SELECT *, {case(lambda r: r.text)} AS rule, {case(lambda r: r.verdict)} AS given, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: {lexical}) AS segs FROM h), "
        "sh AS (SELECT *, concat('/', coalesce(array_to_string(segs, '/'), '')) AS shape FROM base), "
        "shapes AS (SELECT host, shape, segs, count(given) AS labelled, count(*) FILTER (WHERE given = 'block') AS blocked FROM sh GROUP BY host, shape, segs), "
        f"{', '.join(levels)}, "
        f"tree AS MATERIALIZED (SELECT host, shape, labelled, blocked, list_concat(list_filter(string_split(node, '/'), lambda x: x <> ''), CASE WHEN len(segs) > {depth} THEN ['{{...}}'] ELSE [] END) AS names FROM t{depth}), "
        "leaf AS (SELECT host, names, sum(labelled) AS n, sum(blocked) AS b FROM tree GROUP BY host, names), "
        "prior AS (SELECT (sum(b) + 1) * 1.0 / (sum(n) + 2) AS p0 FROM leaf), "
        f"{', '.join(merges)}, "
        f"br AS (SELECT host, node, (sum(b) + 4 * max(e)) / (sum(n) + 4) AS purity FROM m{depth + 1} GROUP BY host, node), "
        f"known AS (SELECT tree.host, shape, CASE WHEN br.node = '' THEN '/' ELSE br.node END AS merged, purity FROM tree JOIN m{depth + 1} m ON tree.host = m.host AND tree.names = m.names JOIN br ON m.host = br.host AND m.node = br.node) "
        "SELECT page_id, sh.host, path, rule, coalesce(given, CASE WHEN purity > 0.8 THEN 'block' ELSE 'allow' END) AS verdict, merged AS template, round(purity, 9) AS purity "
        "FROM sh LEFT JOIN known ON sh.host = known.host AND sh.shape = known.shape"
    )


#: What SQL can say of the operators: the words that stay, and the format read back (roles without control strings).
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM g),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
        u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.doc_id)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """,
    "op4_url_filter": _url_sql(),
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM s),
        r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g),
        x AS (SELECT doc_id, i, unnest(range(0, 20)) AS j FROM r WHERE n > 1),
        c AS (SELECT DISTINCT doc_id, i + j AS p FROM x),
        e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS t, count(*) AS m FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.p = c.p WHERE c.p IS NULL GROUP BY e.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(m, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id
    """,
    "op7_chat_formatting": f"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        o AS (SELECT *, {_TURN_SIZE} AS n, row_number() OVER w AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, r DESC, t DESC) AS z FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, r, t)),
        p AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM o)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(r, chr(10), t, chr(10)), '' ORDER BY k)) AS turns_sha256,
            CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(t, '' ORDER BY k) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
            CAST(sum(CASE WHEN r = 'assistant' OR z = 1 THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars,
            count(*) FILTER (WHERE r = 'assistant' AND length(t) > 0) AS n_examples
        FROM p GROUP BY conv_id
    """,
}
