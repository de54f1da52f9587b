"""Personal data: fixed patterns as seeds, and contexts learned from them; by DataFrame functions only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, documents, fresh, materialize, small, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Java forms of the contract's patterns. A possessive quantifier or a look-behind is put in only where
#: it can't change the leftmost match: it keeps long runs linear and off the stack.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a valid match of the kind has somewhere: one search tells most texts apart.
SIGNS = {"email": rf"[{LOCAL}]@[A-Za-z0-9-]++\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Where a text is cut into parts: before a word, and behind a label's sign or an opening bracket or quote.
PIECE = r"(?<=[\s:=#(<\['\x22])(?:(?=[^\s:=#(<\['\x22])|(?<=\s)(?=\S))"
#: What may stand where a seed of a kind stands: for an email an address written in words, else any word; for the others digit groups joined over spaces, else a word with a digit.
AT, DOT = r"(?:\x20?[(\[<{]\x20?at\x20?[)\]>}]\x20?|\x20at\x20|\x20?@\x20?)", r"(?:\x20?[(\[<{]\x20?dot\x20?[)\]>}]\x20?|\x20dot\x20)"
WRITTEN = rf"[\p{{L}}\p{{N}}._%+-]++{AT}[\p{{L}}\p{{N}}._-]++(?:{DOT}[\p{{L}}\p{{N}}._-]++)*+"
SHAPES = {"email": rf"^(?i:{WRITTEN}|\S++)", "number": r"^(?:[+(]*[0-9][0-9().-]*+(?:\x20\(?[0-9][0-9().-]*+)+|[^\s0-9]*+[0-9]\S*+)"}
#: Parts of a block, and parts before and from a place that are looked at. Each place's row has its block with it, so blocks are short.
BLOCK, BEFORE, AFTER = 64, 12, 12
#: Distinct seeds that a context must have, the confidence that it must keep, and rounds of scoring.
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.8, 3
CONTEXT = 64
#: A context is a pattern while it has at most so many places for each place of a seed.
PLACES = 10
#: The share of texts (one in so many) whose places alone show that a context is none.
PART = 16
#: Contexts or values that are few enough to look for each of them in a whole text.
FEW = 20
WHITE = " \t\n\x0b\x0c\r\x85\u00a0"


def matches(text: Column, pattern: str) -> Column:
    """All leftmost matches as structs of start, stop (code points) and value.

    The parts between the matches come from split() with the same pattern; a
    match starts after all parts and matches before it.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,value:string>>").alias("out"))

    def step(state: Column, item: Column) -> Column:
        begin = state["at"] + item["gap"]
        stop = begin + F.length(item["value"])
        span = F.struct(begin.alias("start"), stop.alias("stop"), item["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    items = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    return F.aggregate(items, start, step, lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _valid(kind: str, m: Column) -> Column:
    digits = _digits(m["value"])
    if kind == "ip":
        return F.forall(F.split(m["value"], r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


SPAN = "array<struct<start:int,rank:int,kind:string,stop:int,value:string>>"


def base_spans(text: Column) -> Column:
    """The fixed patterns' valid matches of all kinds, sorted by start and kind."""
    def of_kind(rank: int, kind: str) -> Column:
        valid = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m))
        spans = F.transform(valid, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["stop"].alias("stop"), m["value"].alias("value")))
        sign = {"email": "@", "ip": ".", "phone": "+"}.get(kind, "")
        return F.when(F.contains(text, F.lit(sign)) & text.rlike(SIGNS[kind]), spans).otherwise(F.array().cast(SPAN))

    parts = [of_kind(rank, kind) for rank, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def context(text: Column, start: Column) -> Column:
    """The lexical pattern to the left of a place: the last word if it is a label such as `mail:`, else the last two; null if there are too few."""
    return _context(F.substring(text, F.greatest(start - CONTEXT + 1, F.lit(1)), F.least(start, F.lit(CONTEXT))), start > CONTEXT)


def _context(before: Column, cut: Column) -> Column:
    words = F.array_remove(F.split(F.lower(before), r"\s+"), "")
    one = F.get(words, F.size(words) - 1)
    two = F.concat_ws(" ", F.get(words, F.size(words) - 2), one)
    whole = F.size(words) > F.when(cut, 2).otherwise(1)  # the first word may have been cut
    return F.when(one.rlike("[:=#]$"), one).when(whole, two)


def _bare(part: Column) -> Column:
    return F.regexp_replace(part, r"^[^\p{L}\p{N}+@]+|[^\p{L}\p{N}]+$", "")


def _last(part: Column) -> Column:
    """What is compared first of a context: its last part. White space stands only behind a part."""
    low = F.rtrim(F.lower(part))
    other = _any([low.endswith(c) for c in WHITE[1:]])
    return F.when(other, F.rtrim(low, F.lit(WHITE))).otherwise(low)


def _ends(before: Column, part: Column) -> Column:
    """A hash of the last two parts of a context; of the last alone if it may be a label or has no word."""
    ascii_word = (part >= "0") & (part < ":") | (part >= "A") & (part < "[") | (part >= "a") & (part < "{")  # by the first character, to save the search
    alone = _any([F.contains(part, F.lit(c)) for c in ":=#"]) | ~(ascii_word | part.rlike(r"[\p{L}\p{N}]"))
    return F.xxhash64(F.when(alone, F.lit("")).otherwise(F.coalesce(_last(before), F.lit(""))), F.coalesce(_last(part), F.lit("")))


def blocks(docs: DataFrame, t: Column) -> DataFrame:
    """A row for each block of parts of each text: key, at, skip, parts, n and base.

    A block has some parts of its neighbours too: `skip` before its own `n`. It
    begins at code point `at`. base: start and stop of the fixed patterns' spans
    that its places may touch. Nothing is shuffled, and no row grows with its text.
    """
    spans = F.transform(base_spans(t), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    of = docs.select(F.xxhash64(t).alias("key"), F.split(t, PIECE, -1).alias("parts"), spans.alias("spans"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<b:int,at:int>>").alias("out"))

    def step(state: Column, b: Column) -> Column:
        begin = F.struct(b.alias("b"), state["at"].alias("at"))
        return F.struct((state["at"] + F.length(_joined(F.col("parts"), b + 1, F.lit(BLOCK)))).alias("at"), F.concat(state["out"], F.array(begin)).alias("out"))

    def block(x: Column) -> Column:
        b, low = x["b"], F.greatest(x["b"] - BEFORE, F.lit(0))
        return F.struct(x["at"].alias("own"), (b - low).alias("skip"), F.slice("parts", low + 1, b - low + BLOCK + AFTER).alias("parts"), F.least(F.lit(BLOCK), F.size("parts") - b).alias("n"))

    begins = F.aggregate(F.sequence(F.lit(0), F.size("parts") - 1, F.lit(BLOCK)), none, step, lambda s: s["out"])
    cut = of.select("key", "spans", F.explode(F.transform(begins, block)).alias("b")).select("key", "spans", "b.*")
    at = F.col("own") - F.length(_joined(F.col("parts"), F.lit(1), F.col("skip")))
    end = F.col("own") + F.length(F.array_join("parts", ""))  # or less
    inside = F.filter("spans", lambda s: (s["start"] < end) & (F.col("own") < s["stop"]))
    return cut.select("key", at.alias("at"), "skip", "parts", "n", F.when(F.size("spans") > 0, inside).otherwise(F.col("spans")).alias("base"))


def _joined(parts: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(parts, start, n), "")


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row: a generator's row isn't put into every expression that uses it, as a plain column is.

    It isn't compiled, so what stands in a column twice is computed twice.
    """
    return df.drop(*columns).select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _lead() -> Column:
    """The punctuation before the word of part i of a block."""
    return F.regexp_extract(F.get("parts", F.col("i")), r"^[^\p{L}\p{N}+@]*", 0)


def _start() -> Column:
    return F.col("at") + F.length(_joined(F.col("parts"), F.lit(1), F.col("i"))) + F.length(_lead())


def _tail() -> Column:
    """The text from the word of part i on."""
    return F.substring(_joined(F.col("parts"), F.col("i") + 1, F.lit(AFTER)), F.length(_lead()) + 1, F.lit(2**31 - 1))


def _here() -> Column:
    """The context of the word of part i."""
    low = F.greatest(F.col("i") - BEFORE, F.lit(0))
    before = F.concat(_joined(F.col("parts"), low + 1, F.col("i") - low), _lead())
    return _context(F.right(before, F.lit(CONTEXT)), (F.col("at") > CONTEXT) | (_start() > CONTEXT))


def _untouched(start: Column, stop: Column) -> Column:
    """Whether no fixed pattern's span touches these. A place's start is only computed where its block has such spans."""
    return (F.size("base") == 0) | ~F.exists("base", lambda s: (s["start"] < stop) & (start < s["stop"]))


def _candidates(of: DataFrame, contexts: DataFrame) -> DataFrame:
    """context, kind, value and n of what stands in the given contexts (context, kind) and has the kind's shape.

    of: blocks. A place's context is put together where the two parts before it
    end one of the contexts, the rest where the whole context is one of them.
    Only emails may be without a digit.
    """
    pieces = F.split("context", PIECE, -1)
    ends = contexts.select(_ends(F.get(pieces, F.size(pieces) - 2), F.element_at(pieces, -1)).alias("ends"), (F.col("kind") == "email").alias("any"))
    ends = ends.groupBy("ends").agg(F.max("any").alias("any"))
    first = F.greatest("skip", F.lit(1))  # a text's first part has none before it
    parts = of.select("*", F.posexplode(F.slice("parts", first, F.col("skip") + F.col("n") - first)).alias("p", "part"))
    parts = parts.withColumn("i", F.col("p") + first)
    word = F.get("parts", F.col("i"))
    digit = word.rlike(r"[0-9]|\S\z")  # or what follows without a space may have one
    if ends.filter("any").isEmpty():
        parts = parts.filter(digit)
    found = parts.withColumn("here", _ends(F.get("parts", F.col("i") - 2), F.col("part"))).join(small(ends, ends.count()), (F.col("here") == F.col("ends")) & (F.col("any") | digit), "left_semi")
    found = found.drop("here", "p", "part", "skip", "n").filter(word.rlike(r"[\p{L}\p{N}]"))
    # a join asks for its key twice if it may be null
    found = found.withColumn("place", F.coalesce(_here(), F.lit("")))
    at = found.join(small(contexts, contexts.count()), (F.col("place") == F.col("context")) & ((F.col("kind") == "email") | digit))
    at = _computed(at, start=_start(), tail=_tail())
    shape = F.when(F.col("kind") == "email", F.regexp_extract("tail", SHAPES["email"], 0)).otherwise(F.regexp_extract("tail", SHAPES["number"], 0))
    at = _computed(at.select("context", "kind", "base", "start", "tail"), value=F.regexp_replace(shape, r"[^\p{L}\p{N}]+$", ""))
    at = at.filter("value != ''").filter(_untouched(F.col("start"), F.col("start") + F.length("value")))
    return at.groupBy("context", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def possible(part: DataFrame, seeds: DataFrame, contexts: DataFrame, right: DataFrame | None = None, kept: Written | None = None) -> DataFrame:
    """Those of the contexts (context, kind) that may be patterns; part: the blocks of some of the texts.

    A context has at least the places of its seeds and those in these texts. If
    these alone are too many, so are all, and the other texts need not be
    searched for it. What is kept is counted in full later.
    """
    of_seeds = seeds.groupBy("context").agg(F.sum("n").alias("of_seeds"))
    hits = seeds.groupBy("context", "kind").agg(F.sum("n").alias("hits")).join(contexts, ["context", "kind"])
    room = hits.join(of_seeds, "context").withColumn("room", PLACES * F.col("hits") - F.col("of_seeds")).filter("room >= 0")
    room = materialize(room.select("context", "kind", "room"), kept)
    found = _candidates(part, room.select("context", "kind"))
    if right is not None:
        found = found.join(right, ["value", "kind"], "left_anti")
    found = found.groupBy("context", "kind").agg(F.sum("n").alias("found"))
    return room.join(found, ["context", "kind"], "left").filter(F.coalesce("found", F.lit(0)) <= F.col("room")).select("context", "kind")


def _any(conditions: list[Column]) -> Column:
    return functools.reduce(Column.__or__, conditions, F.lit(False))


def around(docs: DataFrame, t: Column, contexts: DataFrame) -> DataFrame:
    """The texts that may have a candidate in any of the contexts (context, kind): with a digit, or with the words of an email's context."""
    emails = [r["context"] for r in contexts.filter("kind = 'email'").select("context").limit(FEW + 1).collect()]
    if len(emails) > FEW:
        return docs
    low = fresh(docs, "_low")
    # lower-casing looks at what stands around some letters, none of them ASCII
    words = [[F.contains(F.col(low), F.lit(w)) for w in c.split(" ") if w.isascii()] for c in emails]
    asked = [functools.reduce(Column.__and__, w, F.lit(True)) for w in words]
    if not contexts.filter("kind != 'email'").isEmpty():
        asked.append(t.rlike("[0-9]"))
    return _computed(docs, **{low: F.lower(t)}).filter(_any(asked)).drop(low)


def _first() -> Column:
    """The word of a value's first part."""
    return _bare(F.get(F.split("value", PIECE, -1), F.lit(0)))


def having(docs: DataFrame, t: Column, values: DataFrame) -> DataFrame:
    """The texts that may have any of the values (value, kind); all, if the values are many."""
    few = [r["first"] for r in values.select(_first().alias("first")).filter("first != ''").distinct().limit(FEW + 1).collect()]
    if len(few) > FEW:
        return docs
    return docs.filter(_any([F.contains(t, F.lit(v)) for v in few]))


def _places(of: DataFrame, values: DataFrame) -> DataFrame:
    """The places of the given values (value, kind), each with its block and its number i there. of: blocks.

    A value of one part stands just where that part's word is the value; only
    for longer ones is the text from a place put together.
    """
    keyed = values.withColumn("of", F.split("value", PIECE, -1)).select("value", "kind", (F.size("of") == 1).alias("single"), _first().alias("first")).filter("first != ''")
    parts = of.select("*", F.posexplode(F.slice("parts", F.col("skip") + 1, F.col("n"))).alias("p", "part"))
    at = parts.withColumn("first", F.coalesce(_bare(F.col("part")), F.lit(""))).join(small(keyed, keyed.count()), "first")
    at = at.withColumn("i", F.col("p") + F.col("skip")).drop("first", "p", "part", "skip", "n")
    whole = F.startswith(_tail(), "value") & ~F.substring(_tail(), F.length("value") + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    return at.filter(F.col("single") | whole).filter(_untouched(_start(), _start() + F.length("value")))


def _counts(of: DataFrame, values: DataFrame) -> DataFrame:
    """kind, value and places: how often each of the given values (value, kind) stands anywhere; no row for one that never does."""
    return _places(of, values).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("places"))


def _standing(of: DataFrame, values: DataFrame, contexts: DataFrame) -> DataFrame:
    """context, kind, value and n: how often each of the given values (value, kind) stands in each of the contexts (context, kind), and in all others, as null."""
    at = _places(of, values).withColumn("place", F.coalesce(_here(), F.lit(""))).select("kind", "value", "place")
    asked = contexts.select("context", F.col("kind").alias("_kind"))
    at = at.join(small(asked, asked.count()), (F.col("place") == F.col("context")) & (F.col("kind") == F.col("_kind")), "left")
    return at.groupBy("context", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def _occurrences(of: DataFrame, values: DataFrame) -> DataFrame:
    """key, kind, value, start, stop and context of all places of the given values (value, kind)."""
    at = _computed(_places(of, values), start=_start(), context=_here())
    return at.select("key", "kind", "value", "start", (F.col("start") + F.length("value")).alias("stop"), "context")


def patterns_of(seeds: DataFrame, candidates: DataFrame, support: int = SUPPORT) -> DataFrame:
    """context, kind, hits and total: how often seeds of the kind, and anything, stand in a context that has `support` seeds and a candidate."""
    hits = seeds.groupBy("context", "kind").agg(F.sum("n").alias("hits"), F.countDistinct("value").alias("seeds")).filter(F.col("seeds") >= support)
    total = seeds.select("context", "n").groupBy("context").agg(F.sum("n").alias("of_seeds"))
    others = candidates.groupBy("context", "kind").agg(F.sum("n").alias("of_others"))
    known = hits.join(total, "context").join(others, ["context", "kind"]).withColumn("total", F.col("of_seeds") + F.col("of_others"))
    return known.select("context", "kind", "hits", "total")


def _pattern() -> Column:
    """Whether seeds are often enough among the places of a context for it to say anything of the others: it has no more candidates than a multiple of its seeds."""
    return F.col("total") <= PLACES * F.col("hits")


def _strong() -> Column:
    """A pattern can have right instances only if seeds are half of what its context has."""
    return 2 * F.col("hits") >= F.col("total")


def reached(known: DataFrame, candidates: DataFrame, rounds: int = ROUNDS, kept: Written | None = None) -> DataFrame:
    """The candidates that any strong pattern's score depends on in so many rounds.

    These are its own, in each round before the last also those that share a
    pattern with them. All others can neither be right nor change what is, so
    their places needn't be counted.
    """
    patterns = known.filter(_strong()).select("context", "kind")
    for _ in range(rounds):
        values = materialize(candidates.join(patterns, ["context", "kind"], "left_semi").select("value", "kind").distinct(), kept)
        patterns = candidates.join(values, ["value", "kind"], "left_semi").select("context", "kind").distinct()
    return candidates.join(values, ["value", "kind"], "left_semi")


def confident_values(known: DataFrame, candidates: DataFrame, counts: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, kept: Written | None = None) -> DataFrame:
    """(value, kind) of the instances that are right with at least `confidence`.

    known: what patterns_of() gives for the seeds and all candidates.
    candidates: context, kind, value, n; no seeds, at least all that are
    reached(). counts: kind, value, places; how often a candidate stands
    anywhere. A seed has score 1 for its kind. Each round a pattern scores the
    share of its occurrences that its instances' scores make up, and each
    instance the chance that one of its patterns is right; a plain word, which
    may stand anywhere, times the share of its places that are in the patterns.
    Every step is a sum per key, joined back, so no pattern's instances meet in
    one group.
    """
    plain = ~F.col("value").rlike(r"[0-9@]|(?i)[(\[<{\x20]at[)\]>}\x20]")
    inside = candidates.groupBy("kind", "value").agg(F.sum("n").alias("inside")).join(counts, ["kind", "value"])
    share = materialize(inside.select("kind", "value", F.when(plain, F.least(F.col("inside") / F.col("places"), F.lit(1.0))).otherwise(F.lit(1.0)).alias("share")), kept)
    patterns = known.withColumn("score", F.col("hits") / F.col("total"))
    doubt = F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))
    chances = lambda of: candidates.join(of, ["context", "kind"]).groupBy("value", "kind").agg((1 - doubt).alias("chance")).join(share, ["value", "kind"]).select("value", "kind", (F.col("chance") * F.col("share")).alias("chance"))
    for _ in range(rounds):
        more = candidates.join(chances(patterns), ["value", "kind"]).groupBy("context", "kind").agg(F.sum(F.col("n") * F.col("chance")).alias("more"))
        score = (F.col("hits") + F.coalesce("more", F.lit(0.0))) / F.col("total")
        patterns = materialize(known.join(more, ["context", "kind"], "left").select("context", "kind", "hits", "total", score.alias("score")), kept)
    return chances(patterns.filter((F.col("score") >= confidence) & _strong())).filter(F.col("chance") >= confidence).select("value", "kind")


def extract(docs: DataFrame, id_: str = "doc_id", text: str = "text", kept: Written | None = None) -> DataFrame:
    """Spans of personal data in whole texts: id, base and found.

    base: the fixed patterns' spans; found: spans that are learned from their
    contexts. Contexts of enough seeds give candidates of the seeds' kind;
    those that are confident are found at all their places, and are seeds for
    the contexts there in the next round, until no context is new. Both are
    arrays of start, rank (of the kind), kind, stop and value, sorted. Contexts
    with over PLACES places for each of a seed are no patterns; as values become
    seeds, they are looked at again. Null and
    empty texts have none. Repeated rows are alike, an empty table gives no
    rows.
    """
    t = text_or_empty(text)
    of = docs.select(F.col(id_).alias("id"), t.alias("t")).withColumn("base", base_spans(F.col("t")))
    spans = materialize(of.select("id", F.xxhash64("t").alias("key"), "base", F.transform("base", lambda m: context(F.col("t"), m["start"])).alias("left")), kept)
    seeds = spans.select(F.explode(F.arrays_zip("base", "left")).alias("m")).select(F.col("m.left").alias("context"), F.col("m.base.value").alias("value"), F.col("m.base.kind").alias("kind"))
    grouped = lambda of: of.filter("context is not null").groupBy("context", "value", "kind").agg(F.count(F.lit(1)).alias("n"))
    base_seeds = seeds = materialize(grouped(seeds), kept)
    part = blocks(docs.filter(F.pmod(F.xxhash64(t), F.lit(PART)) == 0), t)
    candidates = at = right = None
    tried = []
    while True:
        contexts = seeds.groupBy("context", "kind").agg(F.countDistinct("value").alias("seeds")).filter(F.col("seeds") >= SUPPORT).select("context", "kind")
        contexts = supported = materialize(contexts, kept)
        for old in tried:
            contexts = contexts.join(old, ["context", "kind"], "left_anti")
        if contexts.isEmpty():
            break
        contexts = materialize(possible(part, seeds, contexts, right, kept), kept)
        if contexts.isEmpty():
            break
        tried.append(contexts)
        new = materialize(_candidates(blocks(around(docs, t, contexts), t), contexts), kept)
        candidates = new if candidates is None else candidates.union(new)
        # what is already known as right counts as a seed, not as a candidate
        others = candidates if right is None else candidates.join(right, ["value", "kind"], "left_anti")
        known = materialize(patterns_of(seeds, others).filter(_pattern()), kept)
        if known.filter(_strong()).isEmpty():
            break
        others = reached(known, others.join(known, ["context", "kind"], "left_semi"), kept=kept)
        values = materialize(others.select("value", "kind").distinct(), kept)
        # a plain word's places in a context that is no pattern, but has its seeds, are not elsewhere
        standing = materialize(_standing(blocks(having(docs, t, values), t), values, supported.join(known, ["context", "kind"], "left_anti")), kept)
        counts = standing.groupBy("kind", "value").agg(F.sum("n").alias("places"))
        others = others.union(standing.filter("context is not null").select(*others.columns))
        more = materialize(confident_values(known, others, counts, kept=kept), kept)
        if more.isEmpty():
            break
        new_at = materialize(_occurrences(blocks(having(docs, t, more), t), more), kept)
        right = more if right is None else right.union(more)
        at = new_at if at is None else at.union(new_at)
        seeds = materialize(base_seeds.union(grouped(at).select(*base_seeds.columns)), kept)
    none = F.array().cast(SPAN)
    if right is None:
        return spans.select("id", "base", none.alias("found"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1
    hits = at.select("key", "start", rank.cast("int").alias("rank"), "kind", "stop", "value").distinct()
    found = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "stop", "value"))).alias("all"))
    inner = lambda m, o: (o["kind"] == m["kind"]) & (o["start"] <= m["start"]) & (m["stop"] <= o["stop"]) & (o["value"] != m["value"])
    found = materialize(found.select(F.col("key").alias("_key"), F.filter("all", lambda m: ~F.exists("all", lambda o: inner(m, o))).alias("found")), kept)
    out = spans.join(small(found, found.count(), 10_000), F.col("key") == F.col("_key"), "left")
    return out.select("id", "base", F.coalesce("found", none).alias("found"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; counts and base_sha256 are of the base spans."""
    out = extract(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    every = F.array_sort(F.concat("base", "found"))
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(every).alias("spans"))
