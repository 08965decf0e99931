"""Query and SQL of line deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from barscope.llm.common import query, table, text_of
from barscope.llm.linededup import MIN_KEY, dedup_lines

SQL_LINES = """
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {docs}),
x AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
o AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= %d GROUP BY key),
f AS (SELECT r, k.doc_id, i, line, coalesce(k.doc_id <> first, false) AS late FROM k LEFT JOIN o ON k.key = o.key),
kept AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (late) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT late), '') AS text FROM f GROUP BY r)""" % MIN_KEY

SQL = f"WITH {SQL_LINES.format(docs='documents')} SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept"


@query("op6_line_dedup", SQL)
def op6(spark, sf):
    d = dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.sha2(text_of(), 256).alias("kept_sha256"),
    )
