"""Quality rules: a table of thresholds compiled into one projection, without user functions or shuffles.

Each rule bounds a ratio of two counts of the text. The counts are column expressions over the word and
line arrays of the row; the verdict is their conjunction. A null or empty text has no words: all counts are
0, ratios over 0 pass no lower bound, and the base rule (fewer than 50 words) fails it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscope.llm.common import SPACE, fields, let, text_of

SYMBOLS = "#*$%&|<>"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with by be this at from or an "
    "der die das und ist nicht ein eine zu den mit auf für von im des dem sich es er sie auch "
    "le la les des et un une du que qui en dans pour par sur est au aux ce pas "
    "el los las y que de por con para una del se no su al como"
).split()
STOPS = sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())})
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Threshold:
    """``low * den <= num <= high * den``; a bound of None is open."""

    name: str
    num: str
    den: str
    low: float | None = None
    high: float | None = None


THRESHOLDS = (
    Threshold("word_length", "word_chars", "n_words", 2.0, 20.0),
    Threshold("symbols", "n_symbols", "n_words", high=0.3),
    Threshold("stop_words", "n_stop", "n_words", low=0.01),
    Threshold("dup_lines", "n_dup_lines", "n_lines", high=0.5),
    Threshold("ellipsis_lines", "n_ellipsis", "n_lines", high=0.5),
    Threshold("bullet_lines", "n_bullets", "n_lines", high=0.9),
)


def compiled(rules: tuple[Threshold, ...]) -> Column:
    verdict = F.lit(True)
    for r in rules:
        num, den = F.col(r.num).cast("double"), F.col(r.den).cast("double")
        if r.low is not None:
            verdict &= num >= den * F.lit(float(r.low))
        if r.high is not None:
            verdict &= num <= den * F.lit(float(r.high))
    return verdict


def _symbols(x: Column) -> Column:
    gone = F.length(x) - F.length(F.regexp_replace(x, f"[{SYMBOLS}]+", ""))
    return F.when(x.rlike(f"[{SYMBOLS}]"), gone).otherwise(0).cast("long")


def _counts(t: Column) -> Column:
    """The counts of a text as one struct."""
    none = F.array().cast("array<bigint>")

    def windows(x: Column) -> Column:
        triple = lambda i: F.xxhash64(F.get(x["w"], i), F.get(x["w"], i + 1), F.get(x["w"], i + 2))
        last = F.size(x["w"]) - 3
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), triple)).otherwise(none)

    def repeated(g: Column) -> Column:
        """Words covered by windows that occur twice; sorting brings equal windows side by side."""
        placed = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
            at = F.sequence(F.lit(0), F.size(s) - 1)
            twice = F.filter(at, lambda j: same(j, j - 1) | same(j, j + 1))
            words = lambda j: F.sequence(F.get(s, j)["i"], F.get(s, j)["i"] + 2)
            return F.size(F.array_distinct(F.flatten(F.transform(twice, words))))

        # Texts without equal windows are not sorted.
        return F.when(F.size(F.array_distinct(g)) < F.size(g), let(placed, count)).otherwise(0)

    def count(x: Column) -> Column:
        w, l = x["w"], x["l"]
        n = lambda c: F.size(c).cast("long")
        return fields(
            n_words=n(w),
            word_chars=F.length(F.concat_ws("", w)).cast("long"),
            n_symbols=_symbols(t),
            n_lines=n(l),
            n_dup_lines=(F.size(l) - F.size(F.array_distinct(l))).cast("long"),
            n_repeat_words=let(windows(x), repeated).cast("long"),
            n_stop=n(F.filter(w, lambda v: v.isin(STOPS))),
            n_ellipsis=n(F.filter(l, lambda v: F.rtrim(v).endswith("..."))),
            n_bullets=n(F.filter(l, lambda v: v.rlike("^ *[-*•]"))),
        )

    words = F.filter(F.split(t, SPACE), lambda v: v != "")
    lines = F.filter(F.split(t, "\n"), lambda v: v.rlike(r"[^\x20\x09-\x0D]"))
    return let(fields(w=words, l=lines), count)


def measures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and the counts that the rules read."""
    return docs.select("doc_id", F.inline(F.array(_counts(text_of()))))


def rate(docs: DataFrame, rules: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """Counts, base verdict and the table's verdict of every row."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    m = measures(docs).withColumn("base_failed", base)
    return m.withColumn("kept", ~F.col("base_failed") & compiled(rules))
