"""Full-text match and BM25 over tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import written

K1, B = 1.2, 0.75


def tokens(text: Column, kind: str = "default") -> Column:
    """The tokens of a text: default (lower-case runs of letters and digits), raw, simple, whitespace or ngram (2 to 3)."""
    if kind == "raw":
        return F.array(text)
    if kind == "whitespace":
        return F.filter(F.split(text, r"\s+"), lambda x: x != "")
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    if kind == "ngram":
        grams = lambda n: F.flatten(F.transform(words, lambda w: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))))
        return F.concat(grams(2), grams(3))
    return words


def match(text: Column, every: list[str] = (), some: list[str] = (), none: list[str] = ()) -> Column:
    """Whether a text has all of `every`, one of `some` if given, and none of `none`."""
    t = tokens(text)
    out = F.lit(True)
    for word in every:
        out &= F.array_contains(t, word)
    if some:
        out &= F.arrays_overlap(t, F.array(*map(F.lit, some)))
    for word in none:
        out &= ~F.array_contains(t, word)
    return out


def phrase(text: Column, words: str) -> Column:
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")), F.lit(f" {words.lower()} "))


def bm25(docs: DataFrame, id_: str, text: str, query: list[str]) -> DataFrame:
    """id and score of the rows that have a query word; higher is better.

    Texts are read and cut into tokens once, into a table of a few numbers a
    row; the corpus figures, one row of sums on the driver, and the scores come
    from that table.
    """
    found = tokens(F.coalesce(F.col(text), F.lit("")))
    # a generator's row is computed once; a plain column would be put into each of the counts
    once = docs.select(F.col(id_), F.inline(F.array(F.struct(found.alias("_t")))))
    t = F.col("_t")
    counts = written(once.select(id_, F.size(t).alias("_n"), *[_count(t, word).alias(f"_{i}") for i, word in enumerate(query)]))
    sums = counts.agg(F.count(F.lit(1)).alias("rows"), F.avg("_n").alias("mean"), *[F.count_if(F.col(f"_{i}") > 0).alias(f"d{i}") for i in range(len(query))]).first()
    score = F.lit(0.0)
    for i in range(len(query)):
        idf = F.log(F.lit(1.0) + (F.lit(float(sums["rows"])) - sums[f"d{i}"] + 0.5) / (F.lit(float(sums[f"d{i}"])) + 0.5))
        tf = F.col(f"_{i}").cast("double")
        score += idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_n") / F.lit(sums["mean"] or 1.0)))
    return counts.select(id_, score.alias("score")).filter("score > 0")


def _count(t: Column, word: str) -> Column:
    return F.size(t) - F.size(F.array_remove(t, word))


def highlight(text: Column, words: list[str], open_tag: str, close_tag: str) -> Column:
    """The text with the tags around each of the words, taken literally, where it is a whole token."""
    any_ = "|".join(re.escape(w) for w in words)
    safe = lambda tag: tag.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}])({any_})(?![\p{{L}}\p{{N}}])", f"{safe(open_tag)}$1{safe(close_tag)}")
