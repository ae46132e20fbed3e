"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import license_scan, ngram_join, pq_dedup, repetition, warc_zip
from .license_rules import RULES

_WORD = r"[^\x20\x09-\x0D]+"


def repetition_sql() -> str:
    """Operator 2: repeats of n words are equal windows of n words, and unions of windows are counted by their gaps."""

    def windows(n: int) -> str:
        return f"""
  p{n} AS (SELECT doc_id, p, array_to_string(ws[p:p + {n - 1}], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS p FROM w)),
  d{n} AS (SELECT doc_id, p FROM p{n} QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
  c{n} AS (SELECT doc_id, CAST(sum(least({n}, coalesce(after - p, {n}))) AS BIGINT) AS n FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS after FROM d{n}) GROUP BY doc_id)"""

    longest = repetition.MAX_LONGEST + 1
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),{windows(repetition.BASE_RUN)},{windows(repetition.MIN_REPEAT)},{windows(longest)},
  l AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{_WORD}') GROUP BY ALL),
  r AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n FROM l GROUP BY doc_id),
  m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(r.n, 0) AS n_dup_lines,
      coalesce(a.n, 0) AS n_repeat_words, coalesce(b.n, 0) AS repeat_covered, c.n IS NOT NULL AS over_long
    FROM w LEFT JOIN r USING (doc_id) LEFT JOIN c{repetition.BASE_RUN} a USING (doc_id) LEFT JOIN c{repetition.MIN_REPEAT} b USING (doc_id) LEFT JOIN c{longest} c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_covered,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * repeat_covered <= {repetition.MAX_COVERED} * n_words AND NOT over_long AS kept
FROM m"""


def license_sql() -> str:
    """Operator 4."""
    table = ",\n  ".join(f"({n}, '{label}', {priority}, '{keyword}', '{regex}')" for n, (label, priority, keyword, regex) in enumerate(RULES))
    spaces = lambda x: f"(length({x}) - length(replace({x}, ' ', ''))) // 2"
    bases = [(f"b{i}", "".join(f" {w} " for w in p.split()), len(p.split()), label) for i, (p, label) in enumerate(license_scan.BASE)]
    return f"""
WITH rules(rank, label, priority, keyword, regex) AS (VALUES
  {table}),
  s AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '{license_scan.SEPARATORS}', '  ', 'g'), ' ') AS x FROM documents),
  t AS (SELECT doc_id, CASE WHEN x = '' THEN '' ELSE ' ' || x || ' ' END AS t FROM s),
  b AS (SELECT doc_id, {spaces("t")} AS n_words, {", ".join(f"string_split(t, '{p}') AS {b}" for b, p, _, _ in bases)} FROM t),
  base AS (SELECT doc_id, n_words, {" + ".join(f"len({b}) - 1" for b, _, _, _ in bases)} AS n_base,
      least({", ".join(f"CASE WHEN len({b}) > 1 THEN {spaces(f'{b}[1]')} END" for b, _, _, _ in bases)}) AS first_word,
      greatest({", ".join(f"CASE WHEN len({b}) > 1 THEN n_words - {spaces(f'{b}[-1]')} - {n} END" for b, _, n, _ in bases)}) AS last_word,
      list_sort(list_filter([{", ".join(f"CASE WHEN len({b}) > 1 THEN '{label}' END" for b, _, _, label in bases)}], lambda x: x IS NOT NULL)) AS base FROM b),
  g AS (SELECT doc_id, rank, label, priority, list_transform(string_split_regex(t, regex), lambda x: {spaces("x")}) AS gaps, list_transform(regexp_extract_all(t, regex), lambda x: {spaces("x")}) AS hits
    FROM t JOIN rules ON contains(t, keyword)),
  d AS (SELECT doc_id, rank, label, priority, f, f + hits[k] AS e FROM (SELECT *, list_sum(gaps[1:k]) + coalesce(list_sum(hits[1:k - 1]), 0) AS f FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM g))),
  kept AS (SELECT doc_id, label, priority FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.doc_id = d.doc_id AND o.f <= d.f AND o.e >= d.e
      AND (o.priority > d.priority OR o.priority = d.priority AND (o.e - o.f > d.e - d.f OR o.e - o.f = d.e - d.f AND o.rank < d.rank)))),
  best AS (SELECT doc_id, list(label) AS found, max(priority) AS top FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_base AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
  greatest(coalesce(top, 0) / 100.0::DOUBLE, CASE WHEN len(base) > 0 THEN 0.5::DOUBLE ELSE 0 END) AS score
FROM base LEFT JOIN best USING (doc_id)"""


def warc_sql() -> str:
    """Operator 8."""
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
  f AS (SELECT *, CASE WHEN n >= {warc_zip.LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""


def vectors_sql() -> str:
    """Operator 1, by all pairs: for small tables."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {pq_dedup.SIMILARITY}),
  r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
  c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, c.c) AS component_id, vec_id = least(vec_id, c.c) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""


def ngram_sql() -> str:
    """Operator 10, by the shingles that pairs share: for small tables."""
    width, top, of = ngram_join.WIDTH, ngram_join.NUMERATOR, ngram_join.DENOMINATOR
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '{_WORD}') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + {width - 1}], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {width - 2}, 2))) AS p FROM w WHERE len(ws) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {of} * c >= {top} * (x.n + y.n - c)),
  r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, least(documents.doc_id, c.c) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = documents.doc_id"""


ORACLE_SQL = {"op10_ngram_join": ngram_sql(), "op1_pq_dedup": vectors_sql(), "op8_warc_zip": warc_sql(), "op2_repetition": repetition_sql(), "op4_license_scan": license_sql()}
