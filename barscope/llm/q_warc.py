"""Query and SQL of WARC archives."""

from __future__ import annotations

from barscope.llm.common import query, table
from barscope.llm.warc import round_trip

# Five hexadecimal digits are four base-32 digits.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
s AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h FROM p),
g AS (SELECT *, list_transform(range(0, 8), lambda k: list_reduce(list_transform(range(1, 6),
        lambda j: instr('0123456789abcdef', h[k * 5 + j]) - 1), lambda a, b: a * 16 + b)) AS v,
        max(page_id) OVER (PARTITION BY h) AS last FROM s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < last THEN last END AS refers_to FROM g
"""


@query("op7_warc", SQL)
def op7(spark, sf):
    return round_trip(table(spark, sf, "pages"))
