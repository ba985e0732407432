"""DuckDB text of the building blocks that the oracles share."""

from __future__ import annotations

from ..functions.text import FOLDED_STOPWORDS

STOP = "[" + ", ".join(f"'{w}'" for w in FOLDED_STOPWORDS) + "]"


def fold(x: str) -> str:
    return f"replace(strip_accents(lower({x})), 'đ', 'd')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all({fold(x)}, '[\p{{L}}\p{{N}}]+'), lambda tk: length(tk) > 1 OR regexp_matches(tk, '^\p{{Nd}}$'))"


def content(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda ct: NOT list_contains({STOP}, ct))"


def estimate(x: str) -> str:
    other = rf"length(regexp_replace({x}, '[\x00-\x7F]', '', 'g'))"
    return f"CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, CAST(floor(length({x}) / (CAST(3.6 AS DOUBLE) - CAST(1.8 AS DOUBLE) * least({other} / length({x}) * CAST(4.0 AS DOUBLE), CAST(1.0 AS DOUBLE)))) AS BIGINT)) END"


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '\S+')"


def sentences(x: str) -> str:
    cut = r"""([.!?…]+["''”’)\]}]*)\s+([\p{Lu}\p{Nd}"''“‘(\[{—\-•*])"""
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '{cut}', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda sn: {strip('sn')}), lambda sn: sn <> '')"


def packed(x: str) -> str:
    start = f"list_transform({sentences(x)}, lambda sx: {{'done': CAST([] AS VARCHAR[]), 'now': sx, 'cost': {estimate('sx')}}})"
    fold_ = f"list_reduce({start}, lambda a, b: CASE WHEN a.cost + b.cost > 320 THEN {{'done': list_append(a.done, a.now), 'now': b.now, 'cost': b.cost}} ELSE {{'done': a.done, 'now': a.now || ' ' || b.now, 'cost': a.cost + b.cost}} END)"
    return f"CASE WHEN {estimate(x)} <= 320 THEN [{x}] ELSE (list_transform([{fold_}], lambda fr: list_append(fr.done, fr.now)))[1] END"


def pieces(x: str) -> str:
    blocks = rf"list_filter(list_transform(string_split_regex({x}, '\n\s*\n+'), lambda bl: {strip('bl')}), lambda bl: bl <> '')"
    return f"flatten(list_transform({blocks}, lambda pb: {packed('pb')}))"


SOURCES = """src AS (
    SELECT lang AS workspace, 'doc-' || doc_id AS source, CASE WHEN doc_id % 10 = 0 THEN 'reference' ELSE 'chapter' END AS kind,
        CASE WHEN doc_id % 10 = 0 THEN NULL ELSE CAST(doc_id AS INTEGER) END AS chapter,
        CASE WHEN doc_id % 10 = 0 THEN doc_id // 10 ELSE 1000 + doc_id END AS ordinal, doc_id, text FROM documents)"""

SEGMENTS = SOURCES + f""", cut AS (SELECT * EXCLUDE (text), {pieces('text')} AS p FROM src),
seg AS (
    SELECT * EXCLUDE (seq1), seq1 - 1 AS seq, (seq1 - 1) // 4 AS scene, '' AS heading, 'prose' AS seg_kind
    FROM (SELECT * EXCLUDE (p), unnest(p) AS text, generate_subscripts(p, 1) AS seq1 FROM cut))"""


def bm25(units: str, key: str, terms: str, name: str = "bm25") -> str:
    """CTEs that end in name(query_id, key, score); terms is a table (query_id, term)."""
    return f"""{name}_tok AS (SELECT {key}, {tokens('text')} AS t FROM {units}),
{name}_len AS (SELECT {key}, length(t) AS len FROM {name}_tok),
{name}_stat AS (SELECT count(*) AS docs, avg(len) AS mean FROM {name}_len),
{name}_post AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(t) AS term FROM {name}_tok) WHERE term IN (SELECT term FROM {terms}) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_post GROUP BY term),
{name} AS (
    SELECT query_id, {key}, sum(ln(1 + (docs - df + 0.5) / (df + CAST(0.5 AS DOUBLE))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score
    FROM {name}_post JOIN {name}_df USING (term) JOIN {terms} USING (term) JOIN {name}_len USING ({key}) CROSS JOIN {name}_stat GROUP BY ALL HAVING score > 0)"""


def fnv(x: str, seed: int) -> str:
    from ..functions.text import FNV_OFFSET

    chars = f"list_prepend(CAST({FNV_OFFSET ^ seed} AS UBIGINT), list_transform(string_split({x}, ''), lambda ch: CAST(ord(ch) & 255 AS UBIGINT)))"
    return f"list_reduce({chars}, lambda h, c: (xor(h, c) * CAST(16777619 AS UBIGINT)) & CAST(4294967295 AS UBIGINT))"


def features(units: str, key: str, name: str = "vec") -> str:
    """CTEs that end in name(key, dim, value)."""
    index, sign = 0x9747B28C, 0x3C6EF372
    return f"""{name}_tok AS (SELECT {key}, {tokens('text')} AS t FROM {units}),
{name}_f AS (
    SELECT {key}, 'w:' || w AS feature, CASE WHEN list_contains({STOP}, w) THEN 0.2 ELSE 1.0 END AS weight FROM (SELECT {key}, unnest(t) AS w FROM {name}_tok)
    UNION ALL
    SELECT {key}, 'c:' || substr(e, i, 3), 0.35 FROM (SELECT {key}, e, unnest(generate_series(1, length(e) - 2)) AS i FROM (SELECT {key}, '^' || w || '$' AS e FROM (SELECT {key}, unnest(t) AS w FROM {name}_tok) WHERE NOT list_contains({STOP}, w)))
    UNION ALL
    SELECT {key}, 'b:' || t[i] || '_' || t[i + 1], 0.5 FROM (SELECT {key}, t, unnest(generate_series(1, length(t) - 1)) AS i FROM {name}_tok)),
{name}_s AS (SELECT {key}, feature, CAST(sum(CAST(weight AS DOUBLE)) AS DOUBLE) AS weight FROM {name}_f GROUP BY ALL),
{name}_h AS (SELECT feature, CAST({fnv('feature', index)} % 384 AS INTEGER) AS dim, CASE WHEN {fnv('feature', sign)} % 2 = 1 THEN 1.0 ELSE -1.0 END AS sign FROM (SELECT DISTINCT feature FROM {name}_s)),
{name}_d AS (SELECT {key}, dim, sum(weight * CAST(sign AS DOUBLE)) AS value FROM {name}_s JOIN {name}_h USING (feature) GROUP BY ALL),
{name} AS (SELECT {key}, dim, value / norm AS value FROM {name}_d JOIN (SELECT {key}, sqrt(sum(value * value)) AS norm FROM {name}_d GROUP BY ALL) USING ({key}) WHERE norm > 0)"""
