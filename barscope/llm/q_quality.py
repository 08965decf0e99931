"""Query and SQL of the quality rules."""

from __future__ import annotations

from barscope.llm.common import query, table
from barscope.llm.quality import MAX_REPEAT_PERCENT, MIN_WORDS, STOPS, SYMBOLS, THRESHOLDS, rate

RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_rule(r) -> str:
    parts = [f"{r.num} >= {r.den} * CAST({r.low} AS DOUBLE)"] if r.low is not None else []
    parts += [f"{r.num} <= {r.den} * CAST({r.high} AS DOUBLE)"] if r.high is not None else []
    return " AND ".join(parts)


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 3)) AS k) GROUP BY r),
m AS (SELECT a.r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        len(list_filter(w, lambda x: x IN ({", ".join(f"'{x}'" for x in STOPS)}))) AS n_stop,
        len(list_filter(l, lambda x: regexp_matches(x, '[.][.][.] *$'))) AS n_ellipsis,
        len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•]'))) AS n_bullets
      FROM a LEFT JOIN rep ON a.r = rep.r),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT {", ".join(RESULT[:-1])}, NOT base_failed AND {" AND ".join(_sql_rule(r) for r in THRESHOLDS)} AS kept FROM b
"""


@query("op10_quality_rules", SQL)
def op10(spark, sf):
    return rate(table(spark, sf, "documents")).select(*RESULT)
