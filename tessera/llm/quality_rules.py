"""Quality rules in a short-circuit cascade, by DataFrame functions only."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, documents, drop, fresh, materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows of the sample on which costs and selectivities are estimated, about, and runs of which the fastest counts.
SAMPLE_ROWS, RUNS = 2000, 3


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: `transform` over a one-element array gives it a name."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text; a text without any gives an empty array."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of words that the text holds twice or more.

    Windows compare by a 64-bit hash. Sorted by hash and place, a window repeats
    if a neighbour has its hash; in the sorted places of these, each window adds
    the words up to the next one's start, at most its length.
    """
    starts = F.sequence(F.lit(0), F.size(words) - window)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))
    places = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda a, i, d: F.coalesce(F.get(a, i + d)["h"] == F.get(a, i)["h"], F.lit(False))
    twice = lambda a: F.sort_array(F.transform(F.filter(F.transform(a, lambda x, i: F.struct(x["i"].alias("i"), (same(a, i, -1) | same(a, i, 1)).alias("t"))), lambda x: x["t"]), lambda x: x["i"]))
    covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(window)), F.lit(window))), F.lit(0), lambda s, x: s + x)
    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(places(h), lambda a: bind(twice(a), covered)))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(bind(hashed, count)).cast("long")


def lines_of(text: Column) -> Column:
    """The lines of a text that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != "")


def signals(text: Column, words: Column) -> dict[str, Column]:
    """Counts of a text (not null) and its words, as long. Each is an expression, computed where it is used."""
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(text) - F.length(_without(text, SYMBOLS)),
        "n_dup_lines": bind(lines_of(text), lambda a: F.size(a) - F.size(F.array_distinct(a))),
        "n_repeat_words": repeat_words(words),
        "n_upper": F.length(F.regexp_replace(text, "[^A-Z]+", "")),
        "n_stutter": F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))),
        "percent_dup_lines": bind(lines_of(text), lambda a: F.when(F.size(a) > 0, F.floor(100 * (F.size(a) - F.size(F.array_distinct(a))) / F.size(a))).otherwise(0)),
    }
    return {name: c.cast("long") for name, c in counts.items()}


@dataclass
class Rule:
    """A rule rejects a row where `reject`, given the signals by name, is true."""

    name: str
    reject: Callable[[dict[str, Column]], Column]


def default_rules() -> list[Rule]:
    return [
        Rule("too_few_words", lambda c: c["n_words"] < 10),
        Rule("repeats", lambda c: 100 * c["n_repeat_words"] > 20 * c["n_words"]),
        Rule("symbols", lambda c: 100 * c["n_symbols"] > 30 * c["n_words"]),
        Rule("stutter", lambda c: 100 * c["n_stutter"] > 20 * c["n_words"]),
        Rule("duplicate_lines", lambda c: c["percent_dup_lines"] > 30),
        Rule("upper_case", lambda c: 100 * c["n_upper"] > 40 * c["word_chars"]),
        Rule("word_length", lambda c: ~(10 * c["word_chars"]).between(15 * c["n_words"], 200 * c["n_words"])),
    ]


@dataclass
class Texts:
    """docs with two more columns: the text, null as empty, and its words, which are split once for all rules."""

    rows: DataFrame
    text: str
    words: str

    @classmethod
    def of(cls, docs: DataFrame, text: str) -> Texts:
        t, w = fresh(docs, "_text"), fresh(docs, "_words")
        found = F.coalesce(F.col(text), F.lit(""))
        # a generator's row is computed once; a plain column would be inlined wherever it is used
        return cls(docs.select("*", F.inline(F.array(F.struct(found.alias(t), words_of(found).alias(w))))), t, w)

    def signals(self) -> dict[str, Column]:
        return signals(F.col(self.text), F.col(self.words))


def order_rules(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling share of rejected rows per cost, both taken on a sample.

    A rule's cost is the time that it takes beyond splitting the words, as the
    fastest of some runs, a quarter of that splitting at least; costs within a
    factor of two count as equal, ties go by name. The order decides only how soon a row leaves the cascade, never
    its verdict, so a noisy clock can't change results.
    """
    rows, kept = docs.count(), Written()
    if not rows:
        return rules
    part = docs.select(F.col(text).alias("text")).sample(min(1.0, sample_rows / rows), seed=7)
    texts = Texts.of(materialize(part.coalesce(4), kept), "text")
    of = texts.signals()
    rejected = {r.name: F.count_if(r.reject(of)).alias(r.name) for r in rules}
    counts = texts.rows.agg(F.count(F.lit(1)).alias("_n"), *rejected.values()).first()

    def fastest(ask: Column) -> float:
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            texts.rows.agg(ask).first()
            took.append(time.perf_counter() - began)
        return min(took)

    base = fastest(F.sum(of["n_words"]))
    cost = {r.name: max(fastest(rejected[r.name]) - base, base / 4) for r in rules}
    drop(docs.sparkSession, kept)
    share = {r.name: (counts[r.name] + 0.5) / (counts["_n"] + 1) for r in rules}
    return sorted(rules, key=lambda r: (-share[r.name] / 2 ** round(math.log2(cost[r.name])), r.name))


def cascade(rules: list[Rule], signals: dict[str, Column]) -> Column:
    """Whether a rule rejects a row. CASE evaluates no rule, and so none of its signals, after the first that does."""
    verdict = F.lit(False)
    for r in reversed(rules):
        verdict = F.when(r.reject(signals), F.lit(True)).otherwise(verdict)
    return verdict


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", counts: tuple[str, ...] = ()) -> DataFrame:
    """Add the signals named in `counts`, for all rows, and `rejected`: whether a rule rejects the row.

    Without `counts`, a row's signals are computed only up to the first rule
    that rejects it. Null and empty texts have no words and are rejected as too
    short; very long ones are read whole. Repeated rows are judged alike; an
    empty table gives no rows. Columns of docs that have the name of a column
    that is added are replaced.
    """
    rules = order_rules(docs, rules or default_rules(), text)
    texts = Texts.of(docs, text)
    of = texts.signals()
    rows = texts.rows.drop(*counts)
    if counts:
        rows = rows.select("*", F.inline(F.array(F.struct(*[of[n].alias(n) for n in counts]))))
    return rows.withColumn("rejected", cascade(rules, of | {n: F.col(n) for n in counts})).drop(texts.text, texts.words)


def passing(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns, whatever their names; see apply_rules()."""
    texts = Texts.of(docs, text)
    rules = order_rules(docs, rules or default_rules(), text)
    return texts.rows.filter(~cascade(rules, texts.signals())).drop(texts.text, texts.words)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict for every document."""
    out = apply_rules(documents(spark, sf_dir).select("doc_id", "text"), counts=BASE)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & ~F.col("rejected")).alias("kept"))
