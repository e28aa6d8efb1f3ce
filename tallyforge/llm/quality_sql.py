"""The quality rules as SQL: the same counts, references and distances in long form."""

from __future__ import annotations

from tallyforge.llm import quality_rules as Q

WORD = r"[^\x20\x09-\x0D]+"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lists() -> str:
    cases = " ".join(f"WHEN {_text(k)} THEN [{', '.join(map(_text, ws))}]" for k, ws in Q.COMMON_WORDS.items())
    return f"CASE lang {cases} ELSE CAST([] AS VARCHAR[]) END"


def _references(name: str, rows: str) -> str:
    """CTEs: shares of languages among `rows` (rid), and the histograms of those with enough words and of all."""
    return f"""
{name}_l AS (SELECT lang, sum(n_words) AS n FROM base JOIN {rows} USING (rid) GROUP BY lang),
{name}_o AS (SELECT lang FROM {name}_l WHERE lang IS NOT NULL AND n >= (SELECT sum(n) FROM {name}_l) * {Q.OWN_SHARE!r}::DOUBLE),
{name} AS (
  SELECT lang, kind, i, CAST(sum(v) AS DOUBLE) AS q FROM hist JOIN {rows} USING (rid) JOIN {name}_o USING (lang) GROUP BY ALL
  UNION ALL SELECT NULL, kind, i, CAST(sum(v) AS DOUBLE) FROM hist JOIN {rows} USING (rid) WHERE kind = 'c' GROUP BY ALL),
{name}_d AS (
  SELECT rid, kind, sqrt(greatest(sum(0.5 * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)), 0)) AS d
  FROM (
    SELECT h.rid, h.kind, h.v / sum(h.v) OVER x AS p, r.q / sum(r.q) OVER x AS q, sum(h.v) OVER x AS sp, sum(r.q) OVER x AS sq
    FROM hist h JOIN base b USING (rid) LEFT JOIN {name}_o o ON o.lang = b.lang
    JOIN {name} r ON r.kind = h.kind AND r.i = h.i AND r.lang IS NOT DISTINCT FROM o.lang
    WHERE b.n_words >= {Q.MIN_WORDS} AND (h.kind = 'c' OR (o.lang IS NOT NULL AND b.listed > 0))
    WINDOW x AS (PARTITION BY h.rid, h.kind))
  WHERE sp > 0 AND sq > 0 GROUP BY rid, kind),
{name}_m AS (
  SELECT rid, c.d AS char_distance, w.d AS common_distance, coalesce(c.d, 0) AS c, coalesce(w.d, 0) AS w
  FROM base LEFT JOIN (SELECT * FROM {name}_d WHERE kind = 'c') c USING (rid) LEFT JOIN (SELECT * FROM {name}_d WHERE kind = 'w') w USING (rid))"""


def judge_sql() -> str:
    upper, punct = r"\p{Lu}", Q.CLASSES["punct"].replace("'", "''")
    n = lambda p: f"len(regexp_extract_all(t, '{p}'))"
    classes = [n(upper), n("[0-9]"), n(Q.SYMBOLS), n(punct), rf"{n(r'[^\x00-\x7F]')} - ({n(upper)} - {n('[A-Z]')})"]
    return rf"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
cnt AS (
  SELECT rid, doc_id, lang, t, regexp_extract_all(t, '{WORD}') AS ws, regexp_extract_all(lower(t), '{WORD}') AS lw, {_lists()} AS lst,
         length(t) AS chars, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, [{', '.join(classes)}] AS cls FROM doc),
tok AS (SELECT rid, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM cnt),
tri AS (SELECT rid, pos, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM tok WINDOW o AS (PARTITION BY rid ORDER BY pos)),
rep AS (SELECT rid, pos FROM (SELECT *, count(*) OVER (PARTITION BY rid, w, w2, w3) AS n FROM tri WHERE w3 IS NOT NULL) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT pos + k) AS n FROM rep, range(0, 3) r(k) GROUP BY rid),
lin AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM doc) WHERE regexp_matches(l, '{WORD}') GROUP BY rid),
base AS (
  SELECT rid, doc_id, lang, len(ws) AS n_words, word_chars, cls[3] AS n_symbols, coalesce(lin.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(lst) AS listed,
         list_concat(cls, [chars - word_chars, word_chars - list_sum(cls)]) AS hc, list_transform(lst, lambda c: len(list_filter(lw, lambda x: x = c))) AS hw, len(lw) AS n_lower
  FROM cnt LEFT JOIN cov USING (rid) LEFT JOIN lin USING (rid)),
hist AS (
  SELECT rid, lang, 'c' AS kind, generate_subscripts(hc, 1) AS i, CAST(unnest(hc) AS DOUBLE) AS v FROM base
  UNION ALL SELECT rid, lang, 'w', generate_subscripts(h, 1), CAST(unnest(h) AS DOUBLE) FROM (SELECT rid, lang, list_append(hw, greatest(n_words - coalesce(list_sum(hw), 0), 0)) AS h FROM base)),
fal AS (SELECT rid, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEATED} * n_words AS failed FROM base),
pas AS (SELECT rid FROM fal WHERE NOT failed),{_references('one', 'pas')},
typ AS (SELECT rid FROM one_m JOIN pas USING (rid) WHERE c <= {Q.ROUGH_CHAR_DISTANCE} AND w <= {Q.ROUGH_COMMON_DISTANCE}),{_references('two', 'typ')}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed AS base_failed,
       NOT failed AND NOT CASE WHEN n_words >= {Q.LONG} THEN c > {Q.MAX_CHAR_DISTANCE} OR w > {Q.MAX_COMMON_DISTANCE}
         ELSE c > {Q.SHORT_CHAR_DISTANCE} OR (c > {Q.BOTH_CHAR_DISTANCE} AND w > {Q.BOTH_COMMON_DISTANCE}) END AS kept,
       round(char_distance, 6) AS char_distance, round(common_distance, 6) AS common_distance
FROM base JOIN fal USING (rid) JOIN two_m USING (rid)"""
