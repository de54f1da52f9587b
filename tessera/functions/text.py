"""Text, blob, digest and identifier functions as Spark columns."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalar import quote


def lower_ascii(x: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def upper_ascii(x: Column) -> Column:
    return F.translate(x, string.ascii_lowercase, string.ascii_uppercase)


def trim(x: Column, characters: str = " ") -> Column:
    return F.btrim(x, F.lit(characters))


def hex_text(x: Column) -> Column:
    return F.hex(x.cast("string").cast("binary"))


def unhex(x: Column, ignore: str = "") -> Column:
    """Bytes of a hexadecimal text; null if it isn't one or has an odd length."""
    digits = F.translate(x, ignore, "") if ignore else x
    return F.when(digits.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(digits))


def char(*codes: Column) -> Column:
    """The text of code points; nulls are left out."""
    one = [F.decode(F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0")), "UTF-32") for c in codes]
    return F.concat_ws("", *one)


def zeroblob(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), F.greatest(n, F.lit(0)).cast("int")))


def get_byte(blob: Column, at: Column) -> Column:
    """The byte at a place from 0."""
    return F.conv(F.hex(F.substring(blob, at + 1, F.lit(1))), 16, 10).cast("int")


def set_byte(blob: Column, at: Column, value: Column) -> Column:
    return F.overlay(blob, F.unhex(F.lpad(F.hex(value.cast("long")), 2, "0")), at + 1, F.lit(1))


def type_name(x: Column) -> Column:
    """null, integer, real, text or blob."""
    kind = F.typeof(x)
    return (
        F.when(x.isNull(), "null")
        .when(kind.isin("tinyint", "smallint", "int", "bigint", "boolean"), "integer")
        .when(kind.isin("float", "double") | kind.startswith("decimal"), "real")
        .when(kind == "binary", "blob")
        .otherwise("text")
    )


def quote_identifier(x: Column) -> Column:
    """Double-quoted unless it is a plain lower-case name."""
    return F.when(x.rlike("^[a-z_][a-z0-9_]*$"), x).otherwise(F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"')))


def printf(fmt: str, *args: Column) -> Column:
    """A literal format put together while planning: %d %i %u %s %f %e %x %X %o %c %q %Q %w %%, with flags, width and precision.

    A null counts as 0 for numbers and as no text for %s, %q and %w; %Q writes NULL.
    """
    left, parts = list(args), []
    for flags, width, precision, code, plain in re.findall(r"%([-+ 0,#]*)(\d*)(\.\d+)?([a-zA-Z%])|([^%]+)", fmt):
        if plain or code == "%":
            parts.append(F.lit(plain or "%"))
            continue
        x = left.pop(0) if left else F.lit(None)
        if code in "diu":
            number = F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint"))
            parts.append(F.format_string(f"%{flags}{width}d", number))
        elif code in "xXo":
            number = F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint"))
            parts.append(F.format_string(f"%{flags.replace(',', '')}{width}{code}", number))
        elif code in "feE":
            number = F.coalesce(x.try_cast("double"), F.lit(0.0))
            flags = flags if code == "f" else flags.replace(",", "")
            parts.append(F.format_string(f"%{flags}{width}{precision or '.6'}{code}", number))
        elif code in "scqQw":
            text = x.cast("string")
            if code == "Q":
                text = quote(text)
            elif code in "qw":
                mark = "'" if code == "q" else '"'
                text = F.replace(text, F.lit(mark), F.lit(mark * 2))
            elif code == "c":
                text = F.substring(text, 1, 1)
            parts.append(F.format_string(f"%{'-' if '-' in flags else ''}{width}{precision or ''}s", F.coalesce(text, F.lit(""))))
        else:
            raise ValueError(f"%{code} is not supported")
    return F.concat(*parts) if parts else F.lit("")


def digest(x: Column, kind: str) -> Column:
    """md5, sha1, sha256, sha384 or sha512 as bytes."""
    data = x.cast("binary")
    return F.unhex({"md5": F.md5, "sha1": F.sha1}[kind](data) if kind in ("md5", "sha1") else F.sha2(data, int(kind[3:])))


def encode(x: Column, kind: str) -> Column:
    """Bytes as hex, base64 or url text."""
    return {"hex": lambda: F.lower(F.hex(x.cast("binary"))), "base64": lambda: F.base64(x.cast("binary")), "url": lambda: F.url_encode(x.cast("string"))}[kind]()


def decode(x: Column, kind: str) -> Column:
    return {"hex": lambda: unhex(x).cast("string"), "base64": lambda: F.unbase64(x).cast("string"), "url": lambda: F.url_decode(x)}[kind]()


def uuid7(ms: Column, random: Column | None = None) -> Column:
    """A version 7 identifier: 48 bits of milliseconds, then those of a random version 4 one."""
    stamp = F.lower(F.lpad(F.hex(ms.cast("long")), 12, "0"))
    other = random if random is not None else F.uuid()
    return F.concat(F.substring(stamp, 1, 8), F.lit("-"), F.substring(stamp, 9, 4), F.lit("-7"), F.substring(other, 16, 21))


def uuid7_ms(x: Column) -> Column:
    return F.conv(F.concat(F.substring(x, 1, 8), F.substring(x, 10, 4)), 16, 10).cast("long")


def tagged(tag: str, value: Column) -> Column:
    """A member of a tagged union."""
    return F.struct(F.lit(tag).alias("tag"), value.alias("value"))


def tagged_value(union: Column, tag: str) -> Column:
    """The union's value if it has this tag, else null."""
    return F.when(union["tag"] == tag, union["value"])
