"""Secrets: fixed patterns, and weak parts of credentials linked where complementary ones co-occur."""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, documents
from .tokens import slices

KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run that is too short fails from any later start too
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Weak parts: an account name in an assignment, a run of letters (of one case or both) and digits, a host with a scheme or port.
WEAK_ID = re.compile(r"""\b(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.I | re.A)
WEAK_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}")
#: A scheme is taken from the start of its run of characters and a port after its host, so that a long run is read once.
URL = re.compile(r"(?<![a-z0-9+])[0-9+]*+([a-z][a-z0-9+]*+://[A-Za-z0-9.-]++(?::[0-9]+)?)", re.A)
PORT = re.compile(r"(?<=[A-Za-z0-9-]):[0-9]{2,5}\b", re.A)
HOST_LETTERS = frozenset(string.ascii_letters + string.digits + ".-")
#: Code points from the end of one part to the start of another that still lie in one scope; a blank line ends a scope too.
REACH = 240
BLANK = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans, sorted. A match that fails a length is dropped and not tried again further right."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _host(text: str, low: int, port: int) -> int:
    """Where the host in front of a port begins: labels with dots between, from the first word boundary on; -1 if there is none."""
    start = low
    if (twice := text.rfind("..", low, port)) >= 0:
        start = twice + 2
    elif text[start] == ".":
        start += 1
    word = lambda i: 0 <= i < port and (text[i].isalnum() and text[i].isascii() or text[i] == "_")
    while start < port and (text[start] == "." or word(start) == word(start - 1)):
        start += 1
    return start if text.find(".", start, port) >= 0 else -1


def endpoints(text: str) -> list[tuple[int, int]]:
    """Hosts with a scheme or a port, from left to right."""
    out, low = [(m.start(1), m.end()) for m in URL.finditer(text)], 0
    for m in PORT.finditer(text):
        at = m.start()
        while at > low and text[at - 1] in HOST_LETTERS:
            at -= 1
        if at < m.start() and (start := _host(text, at, m.start())) >= 0:
            out.append((start, m.end()))
        low = m.start() + 1
    return sorted(out)


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak parts of which complementary ones lie in the same scope.

    An interval join over sorted places: identifiers (access keys and account
    names), secrets (assignments, hexadecimal runs and runs of letters and
    digits) and endpoints look for the part of each other role with the least
    gap to their left and right, in logarithmic time. A weak identifier needs a
    secret in its scope, a weak secret an identifier, an endpoint both. Weak
    parts that touch a base span stand for that span and aren't reported again.
    """
    weak = [(m.start(1), 3, m.end(1)) for m in WEAK_ID.finditer(text)] if re.search(r"[:=]", text) else []
    unnamed = WEAK_ID.sub(lambda m: " " * len(m[0]), text) if weak else text  # an account name is no part of a key
    weak += [(m.start(), 4, m.end()) for m in WEAK_KEY.finditer(unnamed)]
    if ":" in text:
        weak += [(start, 5, end) for start, end in endpoints(text)]
    if not weak:
        return []
    taken: list[list[int]] = []  # base and accepted spans, merged
    for start, _, end in sorted(base):
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    free: list[Span] = []
    for span in sorted(weak):
        at = bisect_left(taken, [span[0] + 1])
        touches = at and taken[at - 1][1] > span[0] or at < len(taken) and taken[at][0] < span[2]
        if not touches and not (free and free[-1][2] > span[0]):
            free.append(span)
    breaks = [m.start() for m in BLANK.finditer(text)]
    role = {0: "secret", 1: "id", 2: "secret", 3: "id", 4: "secret", 5: "endpoint"}
    places: dict[tuple[int, str], tuple[list[int], list[int]]] = {}  # starts, and the furthest end up to each
    for start, kind, end in sorted(base + free):
        starts, ends = places.setdefault((bisect_left(breaks, start), role[kind]), ([], []))
        starts.append(start)
        ends.append(max(end, ends[-1]) if ends else end)

    def near(span: Span, other: str) -> bool:
        starts, ends = places.get((bisect_left(breaks, span[0]), other), ([], []))
        at = bisect_left(starts, span[0])
        return bool(at and span[0] - ends[at - 1] <= reach or at < len(starts) and starts[at] - span[2] <= reach)

    needs = {3: ("secret",), 4: ("id",), 5: ("id", "secret")}
    return [s for s in free if all(near(s, other) for other in needs[s[1]])]


def find(text: str) -> tuple[list[Span], list[Span]]:
    """base and all spans of a text, sorted."""
    base = base_spans(text)
    return base, sorted(base + linked_spans(text, base))


def written(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def redact(text: str, spans: list[Span], mask: str = "[secret]") -> str:
    """The text with each span, overlapping ones as one, replaced by the mask."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of whole texts: id, n_assign, n_access, n_hex, base, spans (`kind:start:end`, comma-joined; code points).

    Null and empty texts have none; an empty table gives no rows. Scopes lie
    within a document, so the rows are joined where they are and nothing is
    shuffled; each row, repeated ones too, stands alone, and a null id stays
    null. The work is in proportion to a text's length.
    """
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [find(t or "") for t in batch.column("text").to_pylist()]
                counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *counts, *[pa.array([written(f[i]) for f in found], pa.string()) for i in range(2)]], names=["id", "n_assign", "n_access", "n_hex", "base", "spans"])

    of = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return arrow(of, run, "id long, n_assign long, n_access long, n_hex long, base string, spans string")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all found secrets masked in `text`; a null stays null. Other columns and their order stay."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for whole in batches:
            for batch in slices(whole, text):
                at = batch.schema.get_field_index(text)
                new = [t and redact(t, find(t)[1]) for t in batch.column(at).to_pylist()]
                yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return arrow(docs, run, docs.schema)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    out = scan(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
