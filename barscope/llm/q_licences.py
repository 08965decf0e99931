"""Query and SQL of the licence scan."""

from __future__ import annotations

from barscope.llm.common import query, table
from barscope.llm.licences import TEMPLATES, scan, vocabulary

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULT = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _branch(t) -> str:
    at, phrase = t.key
    share = " + ".join(
        f"CASE WHEN w[p - {at} + {j + 1}] = '{x}' AND p - {at} + {j + 1} > 0 THEN (SELECT idf FROM idf WHERE x = '{x}') ELSE 0 END"
        for j, x in enumerate(t.words)
    )
    total = " + ".join(f"(SELECT idf FROM idf WHERE x = '{x}')" for x in t.words)
    return (
        f"SELECT r, p, '{t.label}' AS label, {t.base} AS base, round(({share}) / ({total}), 6) AS s FROM"
        f" (SELECT r, w, unnest(range(0, len(w) - {len(phrase) - 1})) AS p FROM a WHERE list_has_all(w, {_list(phrase)})) WHERE w[p + 1 : p + {len(phrase)}] = {_list(phrase)}"
    )


SQL = f"""
WITH a AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(lower(coalesce(text, '')), '{NOT_WORD}'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT unnest({_list(vocabulary())}) AS x),
idf AS (SELECT x, round(ln(((SELECT count(*) FROM a) + 1) / (count(a.r) + 1)) + 1, 6) AS idf
        FROM v LEFT JOIN a ON list_contains(a.w, x) GROUP BY x),
p AS ({" UNION ALL ".join(map(_branch, TEMPLATES))}),
s AS (SELECT r, count(*) FILTER (base) AS n_base, min(p) FILTER (base) AS first_word, max(p) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(s) AS score FROM p GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM a LEFT JOIN s ON a.r = s.r
"""


@query("op2_licences", SQL)
def op2(spark, sf):
    return scan(table(spark, sf, "documents")).select(*RESULT)
