"""Rule scoring and time-series screening over daily bars, as Spark DataFrame operators.

The canonical bar table has one row per ``(code, d)``: ``code`` string, ``d`` date, prices
``o h l c``, volume ``v`` and turnover value ``amount``.  Because the key is unique, a series never
holds more rows than the calendar has days, which is what makes windows over ``code`` safe at any
data size.  Cross-sections (all codes of one date) have no such bound; see ``operators.ranking``.
"""
