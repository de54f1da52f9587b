"""Scalar functions with the reference semantics, as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def cast_integer(x: Column) -> Column:
    """The integer prefix of a text, 0 if there is none."""
    return F.coalesce(F.regexp_extract(x, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def add(a: Column, b: Column) -> Column:
    """Integer sum as a double; try_add gives null on overflow, where the double sum steps in."""
    return F.coalesce(F.try_add(a, b).cast("double"), a.cast("double") + b.cast("double"))


def divide_integer(a: Column, b: Column) -> Column:
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def remainder(a: Column, b: Column) -> Column:
    return a.cast("bigint") % F.nullif(b.cast("bigint"), F.lit(0))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps; 64-bit numbers need at most 92."""
    pair = lambda x, y: F.struct(x.cast("bigint").alias("a"), y.cast("bigint").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(pair(s["b"], s["a"] % F.nullif(s["b"], F.lit(0).cast("bigint"))))
    return F.abs(F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair(a, b), step)["a"])


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple; 0 if either is 0."""
    by = gcd(a, b)
    return F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise(F.abs(F.call_function("div", a.cast("bigint"), by) * b))


def shift_left(a: Column, n: int) -> Column:
    """Shift by n, to the right if n is negative; 64 and more shift all bits out."""
    if n < 0:
        return F.shiftright(a, min(-n, 63))
    return F.lit(0).cast("bigint") if n > 63 else F.shiftleft(a, n)


def like(x: Column, pattern: str) -> Column:
    return x.ilike(pattern)


def glob(x: Column, pattern: str) -> Column:
    """Case-sensitive *, ? and [..] over the whole text."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c in "*?":
            out += ".*" if c == "*" else "."
        elif end > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "^!" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return x.rlike(f"(?s)^{out}$")


def greatest(*xs: Column) -> Column:
    """The largest value; null if any is null."""
    return F.when(_any_null(xs), None).otherwise(F.greatest(*xs))


def least(*xs: Column) -> Column:
    return F.when(_any_null(xs), None).otherwise(F.least(*xs))


def _any_null(xs) -> Column:
    out = F.lit(False)
    for x in xs:
        out |= x.isNull()
    return out


def concat(*xs: Column) -> Column:
    """Text of all that isn't null."""
    return F.concat_ws("", *xs)


def substr(x: Column, start: int, length: int | None = None) -> Column:
    """Start from 1, from the end if negative; 0 is the place before the first. A negative length takes what comes before."""
    n = F.length(x)
    begin = F.lit(start) if start >= 0 else n + start + 1
    if length is None:
        low, high = begin, n + 1
    elif length >= 0:
        low, high = begin, begin + length
    else:
        low, high = begin + length, begin
    low = F.greatest(low, F.lit(1))
    return F.substring(x, low, F.greatest(high - low, F.lit(0)))


def soundex(x: Column) -> Column:
    return F.when(x.rlike("[A-Za-z]"), F.soundex(x)).otherwise(F.lit("?000"))


def quote(x: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def unicode(x: Column) -> Column:
    return F.ascii(x)


def number_or_null(x: Column) -> Column:
    """NaN does not exist: out-of-domain results are null."""
    return F.when(~F.isnan(x), x)


def replace_first(x: Column, pattern: str, replacement: str) -> Column:
    """Only the first match is replaced: the rest of the text is matched along and put back."""
    return F.regexp_replace(x, rf"(?s)^(.*?)(?:{pattern})(.*)$", f"$1{replacement}$2")


def month_add(day: Column, months: int, mode: str = "roll") -> Column:
    """A date some months on. A day that the month lacks rolls into the next one, or is its last (`floor`)."""
    floor = F.add_months(day, months)
    if mode == "floor":
        return floor
    return F.date_add(floor, F.dayofmonth(day) - F.dayofmonth(floor))


def weekday_on(day: Column, n: int) -> Column:
    """The first day from `day` on that is weekday n (0: Sunday)."""
    return F.date_add(day, F.pmod(F.lit(n) - (F.dayofweek(day) - 1), F.lit(7)))


def julianday(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 86400e6 + 2440587.5


STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "I": "hh", "p": "a"}


def strftime(fmt: str, ts: Column) -> Column:
    """A literal format put together from date_format() parts."""
    parts = []
    for code, plain in re.findall(r"%(.)|([^%]+)", fmt):
        if plain or code == "%":
            parts.append(F.lit(plain or "%"))
        elif code in STRFTIME:
            parts.append(F.date_format(ts, STRFTIME[code]))
        elif code == "w":
            parts.append((F.dayofweek(ts) - 1).cast("string"))
        elif code == "u":
            parts.append((F.weekday(ts) + 1).cast("string"))
        elif code == "s":
            parts.append(F.unix_seconds(ts.cast("timestamp")).cast("string"))
        elif code == "J":
            parts.append(julianday(ts).cast("string"))
        else:
            raise ValueError(f"%{code} is not supported")
    return F.concat(*parts)


def array_slice(a: Column, start: Column, end: Column) -> Column:
    """1-based and inclusive, cut to the array."""
    low, high = F.greatest(start, F.lit(1)), F.least(end, F.size(a))
    return F.when(high >= low, F.slice(a, low, F.greatest(high - low + 1, F.lit(1)))).otherwise(F.slice(a, 1, 0))


def array_position(a: Column, x: Column) -> Column:
    return F.nullif(F.array_position(a, x), F.lit(0).cast("bigint"))


def array_contains_all(a: Column, needles: Column) -> Column:
    return F.size(F.array_except(needles, a)) == 0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance_l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def distance_cos(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(1 - dot(a, b) / norm)


def distance_dot(a: Column, b: Column) -> Column:
    """The negative inner product, so that nearer is less."""
    return -dot(a, b)


def distance_jaccard(a: Column, b: Column) -> Column:
    pair = F.zip_with(a, b, lambda x, y: F.struct(F.least(x, y).cast("double").alias("lo"), F.greatest(x, y).cast("double").alias("hi")))
    low = F.aggregate(pair, F.lit(0.0), lambda s, p: s + p["lo"])
    high = F.aggregate(pair, F.lit(0.0), lambda s, p: s + p["hi"])
    return 1 - F.try_divide(low, high)


def vector(json_text: Column, kind: str = "double") -> Column:
    return F.from_json(json_text, f"array<{kind}>")


def vector_slice(v: Column, start: int, end: int) -> Column:
    return F.slice(v, start + 1, end - start)
