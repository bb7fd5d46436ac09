"""SQL, independent of the DataFrame plans, for queries whose reference needs more than a line: stems, token parts, urls, whole searches."""

from __future__ import annotations

from collections.abc import Sequence

from .functions.stem import _STEP2, _STEP3, _STEP4
from .functions.text import TOKEN


def words(values: Sequence[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in values)


# --- Porter's rules as CASE expressions over one word; Y is a y that counts as a consonant -----------------------------------


def _some(w: str) -> str:
    return f"regexp_matches({w}, '[aeiouy][^aeiouy]')"


def _more(w: str) -> str:
    return f"regexp_matches({w}, '[aeiouy][^aeiouy]+[aeiouy]+[^aeiouy]')"


def _short(w: str) -> str:
    return f"(regexp_matches({w}, '[^aeiouy][aeiouy][^aeiouy]$') AND NOT regexp_matches({w}, '[wxyY]$'))"


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _swap(endings: dict[str, str]) -> str:
    cases = (f"WHEN ends_with(w, '{e}') THEN CASE WHEN {_some(_cut(len(e)))} THEN concat({_cut(len(e))}, '{r}') ELSE w END" for e, r in sorted(endings.items(), key=lambda x: -len(x[0])))
    return f"CASE {' '.join(cases)} ELSE w END"


def stems(source: str) -> str:
    """CTEs that end in ``stems(term, stem)`` of the distinct ``term`` of a table."""
    drop = (
        f"WHEN ends_with(w, '{e}') THEN CASE WHEN {_more(_cut(len(e)))}{' AND regexp_matches(' + _cut(3) + chr(44) + ' ' + chr(39) + '[st]$' + chr(39) + ')' if e == 'ion' else ''} THEN {_cut(len(e))} ELSE w END"
        for e in sorted(_STEP4, key=len, reverse=True)
    )
    past = (
        "CASE WHEN cut IS NULL THEN w WHEN regexp_matches(cut, '(at|bl|iz)$') THEN concat(cut, 'e') "
        "WHEN length(cut) > 1 AND right(cut, 1) = left(right(cut, 2), 1) AND regexp_matches(cut, '[^aeiouylsz]$') THEN left(cut, length(cut) - 1) "
        "WHEN length(cut) > 1 AND right(cut, 1) = left(right(cut, 2), 1) AND regexp_matches(cut, '[^aeiouy]$') THEN cut "
        f"WHEN {_some('cut')} AND NOT {_more('cut')} AND {_short('cut')} THEN concat(cut, 'e') ELSE cut END"
    )
    steps = [
        f"s0 AS (SELECT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g') AS w FROM (SELECT DISTINCT term FROM {source}) WHERE length(term) > 2 AND regexp_full_match(term, '[a-z]+'))",
        f"s1 AS (SELECT term, CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_cut(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_cut(1)} ELSE w END AS w FROM s0)",
        f"s2 AS (SELECT term, CASE WHEN ends_with(w, 'eed') AND {_some(_cut(3))} THEN {_cut(1)} ELSE w END AS w, CASE WHEN ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') AND regexp_matches({_cut(2)}, '[aeiouy]') THEN {_cut(2)} WHEN ends_with(w, 'ing') AND regexp_matches({_cut(3)}, '[aeiouy]') THEN {_cut(3)} END AS cut FROM s1)",
        f"s3 AS (SELECT term, {past} AS w FROM s2)",
        f"s4 AS (SELECT term, CASE WHEN regexp_matches(w, '[yY]$') AND regexp_matches({_cut(1)}, '[aeiouy]') THEN concat({_cut(1)}, 'i') ELSE w END AS w FROM s3)",
        f"s5 AS (SELECT term, {_swap(_STEP2)} AS w FROM s4)",
        f"s6 AS (SELECT term, {_swap(_STEP3)} AS w FROM s5)",
        f"s7 AS (SELECT term, CASE {' '.join(drop)} ELSE w END AS w FROM s6)",
        f"s8 AS (SELECT term, CASE WHEN ends_with(w, 'e') AND ({_more(_cut(1))} OR ({_some(_cut(1))} AND NOT {_short(_cut(1))})) THEN {_cut(1)} ELSE w END AS w FROM s7)",
        f"s9 AS (SELECT term, lower(CASE WHEN ends_with(w, 'll') AND {_more(_cut(1))} THEN {_cut(1)} ELSE w END) AS w FROM s8)",
        f"stems AS (SELECT t.term, coalesce(w, t.term) AS stem FROM (SELECT DISTINCT term FROM {source}) t LEFT JOIN s9 ON t.term = s9.term)",
    ]
    return ", ".join(steps)


def parts(source: str = "documents", key: str = "doc_id", name: str = "") -> str:
    """CTE ``kept(key, term, i, j)``: tokens of a text and, after each, its parts where nothing before them is the same."""
    n = name
    return (
        f"l{n} AS (SELECT {key}, regexp_extract_all(lower(text), '{TOKEN}') AS l FROM {source}), x{n} AS (SELECT {key}, unnest(l) AS term, unnest(range(len(l))) AS i FROM l{n}), "
        f"y{n} AS (SELECT {key}, i, list_filter(list_concat(CASE WHEN contains(term, '.') THEN string_split(term, '.') ELSE [] END, CASE WHEN regexp_matches(term, '[+\\-*/=]') THEN string_split_regex(term, '[+\\-*/=]') ELSE [] END), lambda s: s <> '') AS p FROM x{n}), "
        f"z{n} AS (SELECT {key}, term, i, 0 AS j FROM x{n} UNION ALL SELECT {key}, unnest(p), i, unnest(range(1, len(p) + 1)) FROM y{n}), "
        f"kept{n} AS (SELECT {key}, term, i, j FROM (SELECT *, row_number() OVER (PARTITION BY {key}, term ORDER BY i, j) AS n FROM z{n}) WHERE j = 0 OR n = 1)"
    )


PARTS = parts()

_BLOCKS = "address|article|aside|blockquote|div|dl|fieldset|footer|form|h1|h2|h3|h4|h5|h6|header|hr|main|nav|ol|p|pre|section|table|ul|li|body|html"


def _shown(html: str) -> str:
    """Text of a piece of HTML whose block tags are gone: other tags out, the entities of the test pages, one space each."""
    text = f"regexp_replace({html}, '<[^>]*>', '', 'g')"
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


_TITLE = "regexp_extract(h, '<title>(.*?)</title>', 1)"
_BODY = f"regexp_replace(h, '</?({_BLOCKS})( [^>]*)?>|<br[^>]*>|</title>', ' ', 'g')"

#: ``d(doc_id, url, title, text)`` and ``el(doc_id, tag, no, text)`` of raw pages that hold titles, headings, paragraphs (closed or not), comments and scripts.
PAGES = (
    "pc AS (SELECT page_id AS doc_id, url, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs') AS h FROM pages WHERE url IS NOT NULL AND html IS NOT NULL), "
    f"d AS (SELECT doc_id, url, {_shown(_TITLE)} AS title, {_shown(_BODY)} AS text FROM pc), "
    f"pm AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<br[^>]*>', ' ', 'g'), '</(p|h1|h2|h3)>', chr(1), 'g'), '</({_BLOCKS})>', ' ', 'g'), '<({_BLOCKS})( [^>]*)?>', concat(chr(1), '<\\1>'), 'g') AS m FROM pc), "
    "pp AS (SELECT doc_id, unnest(string_split(m, chr(1))) AS piece, unnest(range(len(string_split(m, chr(1))))) AS no FROM pm), "
    f"el AS (SELECT doc_id, 'title' AS tag, -1 AS no, title AS text FROM d UNION ALL SELECT doc_id, regexp_extract(piece, '^<(p|h1|h2|h3)>', 1), no, {_shown('piece')} FROM pp WHERE regexp_matches(piece, '^<(p|h1|h2|h3)>'))"
)


def page_terms(stop: Sequence[str]) -> str:
    """CTE ``ew(doc_id, tag, no, term)`` of the pages' elements: parts, no stop words, no stems."""
    return f"{PAGES}, {parts('el', 'doc_id, tag, no', 'e')}, ew AS (SELECT * FROM kepte WHERE length(term) > 1 AND term NOT IN ({words(stop)}))"


def page_engine(stop: Sequence[str]) -> str:
    """As ``engine``, over the elements of raw pages."""
    return (
        f"{page_terms(stop)}, {stems('ew')}, post AS (SELECT stem AS term, doc_id, count(*) AS frequency FROM ew JOIN stems ON ew.term = stems.term GROUP BY 1, 2), "
        "n AS (SELECT count(*) AS n_docs FROM d), stats AS (SELECT term, count(*) AS df, any_value(n_docs) AS n_docs FROM post, n GROUP BY term)"
    )


def engine(stop: Sequence[str]) -> str:
    """CTEs of a search engine's tables over the plain texts: parts, stop words, stems; ``post``, ``len``, ``stats``, ``d``."""
    return (
        f"{PARTS}, ew AS (SELECT * FROM kept WHERE length(term) > 1 AND term NOT IN ({words(stop)})), {stems('ew')}, "
        "post AS (SELECT stem AS term, doc_id, count(*) AS frequency FROM ew JOIN stems ON ew.term = stems.term GROUP BY 1, 2), "
        "len AS (SELECT d.doc_id, count(k.term) AS n_terms FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id), "
        "n AS (SELECT count(*) AS n_docs FROM documents), stats AS (SELECT term, count(*) AS df, any_value(n_docs) AS n_docs FROM post, n GROUP BY term), "
        "d AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS title, concat('https://', source, '.example/', CAST(doc_id AS VARCHAR)) AS url FROM documents)"
    )


def relaxed(terms: Sequence[str]) -> str:
    """CTE ``hit``: documents with all terms, else half of them, else the best."""
    k = len(set(terms))
    return (
        f"c AS (SELECT doc_id, count(DISTINCT term) AS m FROM post WHERE term IN ({words(terms)}) GROUP BY doc_id), "
        f"cs AS (SELECT count(*) FILTER (WHERE m = {k}) AS f, count(*) FILTER (WHERE m >= {max(1, k // 2)}) AS h, count(*) AS a FROM c), "
        "cr AS (SELECT doc_id, m, row_number() OVER (ORDER BY m DESC, doc_id) AS r FROM c), "
        f"hit AS (SELECT doc_id FROM cr, cs WHERE CASE WHEN f > 0 THEN m = {k} WHEN h > 0 THEN m >= {max(1, k // 2)} ELSE r <= greatest(10, a // 5) END)"
    )


_COUNT = "len(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '))"


def live(terms: Sequence[str], source: str = "d") -> str:
    """CTE ``live(doc_id, score)`` of the documents of ``source``."""
    gain = lambda t: (
        f"coalesce((SELECT least(frequency * 1.0 / wc, 0.1) * idf FROM fi WHERE fi.doc_id = dd.doc_id AND term = '{t}') * (1 + CASE WHEN contains(lt, '{t}') THEN 3 ELSE 0 END + CASE WHEN contains(lu, '{t}') THEN 2 ELSE 0 END), 0)"
    )
    found = " + ".join(f"(SELECT count(*) FROM fi WHERE fi.doc_id = dd.doc_id AND term = '{t}')" for t in terms)
    query, every = " ".join(terms), lambda c: " AND ".join(f"contains({c}, '{t}')" for t in terms)
    many = len(terms) > 1
    return (
        f"fi AS (SELECT post.term, doc_id, frequency, log10(n_docs * 1.0 / df) AS idf FROM post JOIN stats ON post.term = stats.term WHERE post.term IN ({words(terms)})), "
        f"dd AS (SELECT doc_id, {_COUNT} AS wc, lower(title) AS lt, lower(url) AS lu, lower(text) AS lx FROM {source}), raw AS (SELECT *, {' + '.join(map(gain, terms))} AS s, {found} AS k FROM dd), "
        f"live AS (SELECT doc_id, CASE WHEN wc < 50 THEN 0.01 WHEN contains(lt, '{query}') THEN 1000 {'WHEN ' + every('lu') + ' THEN 500' if many else ''} WHEN {every('lt')} THEN 300 "
        f"ELSE s * CASE WHEN k < {len(terms) // 2} THEN 0.1 ELSE 1 END * {'CASE WHEN contains(lx, ' + chr(39) + query + chr(39) + ') THEN 3 ELSE 1 END' if many else '1'} END AS score FROM raw)"
    )


def near(terms: Sequence[str], source: str) -> str:
    """CTE ``near(doc_id, bonus)`` of the documents of ``source``."""
    names = list(dict.fromkeys(terms))
    sides = " UNION ALL ".join(f"SELECT doc_id, pos, {i} AS t FROM nw WHERE contains(word, '{t}')" for i, t in enumerate(names))
    last = ", ".join(f"last_value(CASE WHEN t = {i} THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos, t ROWS UNBOUNDED PRECEDING) AS l{i}" for i in range(len(names)))
    other = ", ".join(f"CASE WHEN t <> {i} THEN coalesce(l{i}, -1000) ELSE -1000 END" for i in range(len(names)))
    return (
        f"na AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS a FROM {source}), nw AS (SELECT doc_id, unnest(a) AS word, unnest(range(len(a))) AS pos FROM na), "
        f"nh AS ({sides}), no AS (SELECT doc_id, pos, t, {last} FROM nh), ng AS (SELECT doc_id, min(pos - greatest({other})) AS gap FROM no GROUP BY doc_id), "
        f"near AS (SELECT s.doc_id, CASE WHEN gap <= 3 THEN 2.0 WHEN gap <= 10 THEN 1.0 WHEN gap <= 50 THEN 0.5 ELSE 0.0 END AS bonus FROM {source} s LEFT JOIN ng ON s.doc_id = ng.doc_id)"
    )


def page(scored: str, size: int = 25) -> str:
    """The first page of ``scored(doc_id, score)``."""
    return f"SELECT s.doc_id, d.url, d.title, round(s.score, 6) AS score FROM {scored} s JOIN d ON s.doc_id = d.doc_id ORDER BY s.score DESC, s.doc_id LIMIT {size}"


def holds(phrase: str) -> str:
    return f"(contains(lower(text), '{phrase}') OR contains(lower(title), '{phrase}'))"


def having(term: str) -> str:
    return f"SELECT doc_id FROM post WHERE term = '{term}'"


def phrase_score(phrase: str) -> str:
    hits = f"((length(text) - length(replace(lower(text), '{phrase}', ''))) // {len(phrase)})"
    return f"CASE WHEN contains(lower(title), '{phrase}') THEN 3.0 ELSE 1.0 END * CASE WHEN {hits} > 1 THEN 1 + ln({hits}) ELSE 1 END * CASE WHEN contains(lower(url), '{phrase.replace(' ', '-')}') THEN 2 ELSE 1 END"


def shop(urls: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains(url, '{u}')" for u in urls) + ")"


def boolean_score(phrases: Sequence[Sequence[str]], texts: Sequence[str], form) -> str:  # noqa: ANN001
    """CTE ``boolean(doc_id, score)`` of the documents of ``got``: words of each phrase in turn, doubled where it is found whole."""
    steps = ["SELECT doc_id, wc, lt, lx, 0.0 AS s, false AS done FROM bd"]
    for own, text in zip(phrases, texts, strict=True):
        for w in own:
            steps.append(
                f"SELECT x.doc_id, wc, lt, lx, CASE WHEN done OR f.frequency IS NULL THEN s ELSE s + f.frequency * 1.0 / wc * f.idf + CASE WHEN contains(lt, '{w}') THEN f.frequency * 1.0 / wc * f.idf * 3 ELSE 0 END END AS s, "
                f"done OR (f.frequency IS NULL AND EXISTS (SELECT 1 FROM post WHERE term = '{form(w)}')) AS done FROM {{}} x LEFT JOIN (SELECT * FROM bf WHERE term = '{form(w)}') f ON x.doc_id = f.doc_id"
            )
        steps.append(f"SELECT doc_id, wc, lt, lx, CASE WHEN NOT done AND (contains(lt, '{text}') OR contains(lx, '{text}')) THEN s * 2 ELSE s END AS s, done FROM {{}}")
    every = tuple(sorted({form(w) for own in phrases for w in own}))
    ctes = ", ".join(f"b{i} AS ({q.format(f'b{i - 1}')})" for i, q in enumerate(steps))
    return (
        f"bd AS (SELECT doc_id, {_COUNT} AS wc, lower(title) AS lt, lower(text) AS lx FROM d WHERE doc_id IN (SELECT doc_id FROM got)), "
        f"bf AS (SELECT post.term, doc_id, frequency, log10(n_docs * 1.0 / df) AS idf FROM post JOIN stats ON post.term = stats.term WHERE post.term IN ({words(every)})), "
        f"{ctes}, boolean AS (SELECT doc_id, s AS score FROM b{len(steps) - 1})"
    )


def normalized(url: str) -> str:
    """An http url in its normal form, for paths without dots and repeated slashes: host folded, port and fragment dropped, query sorted, no final slash."""
    bare = f"regexp_replace({url}, '#.*$', '')"
    scheme, host = f"lower(regexp_extract({bare}, '^([A-Za-z]+)://', 1))", f"lower(regexp_extract({bare}, '^[A-Za-z]+://(?:[^/?@]*@)?([^/?:]*)', 1))"
    path, query = f"regexp_extract({bare}, '^[A-Za-z]+://[^/?]*([^?]*)', 1)", f"regexp_extract({bare}, '\\?(.*)$', 1)"
    return f"regexp_replace(concat({scheme}, '://', {host}, {path}, CASE WHEN {query} <> '' THEN concat('?', array_to_string(list_sort(string_split({query}, '&')), '&')) ELSE '' END), '/$', '')"


#: ``links(parent_url, child_url)`` of pages whose hrefs begin with a slash.
LINKS = (
    "hrefs AS (SELECT page_id, url AS parent_url, unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) AS href FROM pages WHERE url IS NOT NULL AND html IS NOT NULL), "
    f"links AS (SELECT DISTINCT parent_url, {normalized('u')} AS child_url FROM (SELECT parent_url, concat(regexp_extract(parent_url, '^([A-Za-z]+://[^/?#]*)', 1), href) AS u FROM hrefs WHERE href <> '' AND NOT starts_with(href, '#')))"
)
