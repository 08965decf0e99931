"""Licence scan with a positional index of rare words.

The templates' words form a small vocabulary. Its inverse document frequency is taken over all texts; the
*rare words* of a template are those of its mandatory phrase with the highest one. A text is scanned for rare words only.
Each occurrence looks up the postings (template, offset), which give the place where the template would
start; the template's other words are then held against the text by relative position. A place counts if
the mandatory phrase stands there word for word; its score is the share of the template's idf that is found.

Base phrases are templates' mandatory phrases too, so every place of them is found through the index: each
place holds the phrase's rare word at its offset. Null and empty texts have no words, places or labels and
score 0. Repeated rows are scanned one by one. Words are counted from 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscope.llm.common import NOT_WORD, fields, let, text_of


@dataclass(frozen=True)
class Template:
    """A licence sentence around a mandatory phrase; ``base`` phrases are reported place by place."""

    label: str
    phrase: str
    before: str = ""
    after: str = ""
    base: bool = False

    @property
    def words(self) -> list[str]:
        return f"{self.before} {self.phrase} {self.after}".split()

    @property
    def key(self) -> tuple[int, list[str]]:
        return len(self.before.split()), self.phrase.split()


# Licence phrases and the words that usually stand around them.
TEMPLATES = (
    Template("mit", "under the mit license", "released", "", True),
    Template("apache-2", "apache license version 2", "licensed under the", "0", True),
    Template("cc-by-nc", "cc by nc", "licensed under", "4 0", True),
    Template("mit", "permission is hereby granted free of charge", "", "to any person obtaining a copy of this software"),
    Template("gpl", "gnu general public license", "this work is licensed under the", "version 3"),
    Template("lgpl", "gnu lesser general public license", "licensed under the", "version 3"),
    Template("agpl", "gnu affero general public license", "licensed under the", "version 3"),
    Template("bsd", "redistribution and use in source and binary forms", "", "with or without modification are permitted"),
    Template("mpl", "mozilla public license", "subject to the terms of the", "v 2 0"),
    Template("isc", "permission to use copy modify and", "", "or distribute this software for any purpose"),
    Template("unlicense", "released into the public domain", "free and unencumbered software", ""),
)


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def words_of(text: Column) -> Column:
    """Lower-case words. Only template words, all ASCII, are looked at, so the full lower-casing does no harm."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def inverse_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """idf of each template word over all texts; as many rows as the templates have words reach the driver."""
    vocab = vocabulary(templates)
    found = F.array_intersect(F.split(F.lower(text_of()), NOT_WORD), F.array(*map(F.lit, vocab)))
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("w")).groupBy("w").count().collect()
    df = {r["w"]: r["count"] for r in rows}
    return {w: round(math.log((df.get("", 0) + 1) / (df.get(w, 0) + 1)) + 1, 6) for w in vocab}


def _places(x: Column, t: Template, rare: str, idf: dict[str, float]) -> Column:
    """Start of the phrase and score of every place of a template, from the occurrences of its rare word."""
    at, phrase = t.key
    offset = phrase.index(rare)
    total = sum(idf[w] for w in t.words)

    def share(p: Column) -> Column:
        hits = [F.when(F.get(x["w"], p - at + j) == w, idf[w]).otherwise(0.0) for j, w in enumerate(t.words)]
        return F.round(sum(hits[1:], hits[0]) / F.lit(total), 6)

    starts = F.transform(F.filter(x["rare"], lambda r: r["w"] == rare), lambda r: r["i"] - offset)
    whole = F.filter(
        starts, lambda p: (p >= 0) & (F.slice(x["w"], F.greatest(p, F.lit(0)) + 1, len(phrase)) == F.array(*map(F.lit, phrase)))
    )
    return F.transform(whole, lambda p: fields(p=p, s=share(p), label=F.lit(t.label), base=F.lit(t.base)))


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per row: doc_id, number of words, places of base phrases, labels and the best score."""
    idf = inverse_frequencies(docs, templates)
    rarest = {t: max(t.key[1], key=lambda w: (idf[w], w)) for t in templates}
    rare = sorted(set(rarest.values()))
    none = F.array().cast("array<struct<w:string,i:int>>")

    def result(w: Column) -> Column:
        placed = F.transform(w, lambda v, i: F.when(v.isin(rare), fields(w=v, i=i)))
        hits = F.when(F.arrays_overlap(w, F.array(*map(F.lit, rare))), F.array_compact(placed)).otherwise(none)

        def found(x: Column) -> Column:
            places = F.concat(*[_places(x, t, rarest[t], idf) for t in templates])
            return F.when(F.size(x["rare"]) > 0, places)

        def summed(p: Column) -> Column:
            base = F.filter(p, lambda v: v["base"])
            at = F.transform(base, lambda v: v["p"])
            labels = lambda q: F.array_join(F.sort_array(F.array_distinct(F.transform(q, lambda v: v["label"]))), ",")
            return fields(
                n_words=F.size(w).cast("long"),
                n_base=F.coalesce(F.when(base.isNotNull(), F.size(base)), F.lit(0)).cast("long"),
                first_word=F.array_min(at).cast("long"),
                last_word=F.array_max(at).cast("long"),
                base_labels=F.coalesce(labels(base), F.lit("")),
                labels=F.coalesce(labels(p), F.lit("")),
                score=F.coalesce(F.array_max(F.transform(p, lambda v: v["s"])), F.lit(0.0)),
            )

        return let(let(fields(w=w, rare=hits), found), summed)

    return docs.select("doc_id", F.inline(F.array(let(words_of(text_of()), result))))
