"""Best-two-fit packing of tokenized documents into sequences."""

from __future__ import annotations

import os
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, arrow, documents, materialize, numbered
from .tokens import slices

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 1024, 2
#: Entries of the cache of words in a Python worker; twice as many, and the words of a batch, are held at most.
CACHE_WORDS = 250_000
#: Bytes of text that are tokenized at once; working space is about 25 times as much.
AT_ONCE = 4 << 20
#: Latin letters, and ASCII punctuation behind them: the split pattern cuts between both.
STEM = r"^(?P<stem> ?[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+)(?P<marks>[!-/:-@\[-`{-~]+)$"
#: White space that is not a single space or line break, and what the split of a batch marks words with.
ODD = r"[ \n][ \n]|[\x00" + "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n") + "]"


class ByteBPE:
    """Ids of whole texts by a byte-level `tokenizers` file, with a cache of words.

    The split pattern puts a single space in front of the word after it and cuts
    around a single line break, so in a text without other white space each
    " word" is encoded alone; one that isn't known yet, with all such words of
    a batch of texts in one call. All other texts, and those that hold a
    special token, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_whole(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def look_up(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, each encoded alone."""
        known, older = self.known, self.older
        if new := [w for w in words if w not in known]:
            unknown = [w for w in new if w not in older]
            known.update((w, older[w]) for w in new if w in older)
            found = self.whole.encode_batch_fast(unknown, add_special_tokens=False)
            known.update(zip(unknown, [array("I", x.ids).tobytes() for x in found], strict=True))
        out = list(map(known.__getitem__, words))
        if len(known) >= CACHE_WORDS:
            self.known, self.older = {}, known
        return out

    def encode(self, texts) -> list[bytes]:
        """Packed unsigned 32-bit ids of each text of an Arrow array; null is empty.

        Words are split, and told apart, by Arrow; letters and the punctuation
        behind them apart, as they meet again in other words.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, ODD)
        for s in self.specials:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        cut = pc.replace_substring(pc.replace_substring(pc.if_else(whole, "", texts), " ", "\0 "), "\n", "\0\n\0")
        lists = pc.split_pattern(cut, "\0")
        words = pc.dictionary_encode(lists.flatten())
        stem, marks = pc.extract_regex(words.dictionary, STEM).flatten()
        stem = pc.dictionary_encode(pc.coalesce(stem, words.dictionary))
        marks = pc.dictionary_encode(pc.fill_null(marks, ""))
        each = self.look_up(stem.dictionary.to_pylist()) + self.look_up(marks.dictionary.to_pylist())
        parts = np.stack([stem.indices.to_numpy(), len(stem.dictionary) + marks.indices.to_numpy()], axis=1)
        size = np.array([len(x) // 4 for x in each], np.int64)
        at = parts[words.indices.to_numpy()].ravel()
        n = size[at]
        flat = np.frombuffer(b"".join(each), np.uint32)
        starts = np.cumsum(size) - size
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts[at] - (ends - n), n) + np.arange(int(n.sum()))]
        stops = np.r_[0, ends][2 * (lists.offsets.to_numpy() - lists.offsets[0].as_py())]
        out = [ids[a:b].tobytes() for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.encode_whole(texts[i].as_py())
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe, last = tokenizer(path), array("I", [end]).tobytes()
        for whole in batches:
            for batch in slices(whole, "text", AT_ONCE):
                rows = []
                for doc, ids in zip(batch.column("id").to_pylist(), bpe.encode(batch.column("text")), strict=True):
                    ids += last
                    n, piece, start = len(ids) // 4, 0, 0
                    stop = n - (n - 1) // capacity * capacity  # a longer document's first piece has what is left over
                    while start < n:
                        part = ids[4 * start : 4 * stop]
                        rows.append((doc, piece, start, stop - start, zlib.crc32(part), np.frombuffer(part, np.uint32).astype(np.int32) if with_ids else None))
                        piece, start, stop = piece + 1, stop, stop + capacity
                of = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(of, kinds)] + ([pa.array(list(of[5]), pa.list_(pa.int32()))] if with_ids else [])
                yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-two-fit over lengths: (lengths of a sequence, how many such sequences).

    Fills a sequence greedily with the longest that fit. Then takes out its
    shortest for the two lengths that fill the gap best, if they fill it better
    than it did, as long as that helps. The same sequence is made as often as
    its lengths last; sequence by sequence the choices would be the same. So the
    work depends on the number of distinct lengths, not of documents.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = np.arange(capacity + 1)
    out = []

    def below() -> np.ndarray:
        return np.maximum.accumulate(np.where(left > 0, lengths, 0))  # the longest length at hand up to each place

    while left.any():
        use, gap = [], capacity
        while (length := int(below()[gap])) > 0:
            use.append(length)
            left[length] -= 1
            gap -= length
        while use:
            room = gap + use[-1]
            best = below()
            first = lengths[: room + 1]
            second = np.where(left[first] > 0, best[room - first], 0)
            alone = (second == first) & (left[first] < 2)
            if alone.any():  # the two would be one and the same document
                second[alone] = best[np.maximum(first[alone] - 1, 0)]
            total = np.where((left[first] > 0) & (second > 0), first + second, 0)
            if not total.size or total.max() <= use[-1]:
                break
            a = int(total.argmax())
            b = int(second[a])
            left[use.pop()] += 1
            left[a] -= 1
            left[b] -= 1
            use = sorted([*use, a, b], reverse=True)
            gap = capacity - sum(use)
        for length in use:
            left[length] += 1
        need = Counter(use)
        times = min(int(left[length]) // n for length, n in need.items())
        for length, n in need.items():
            left[length] -= times * n
        out.append((tuple(use), times))
    return out


def _slots(made: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) for each place of each kind of sequence."""
    out, ranks, sequence = [], Counter(), 0
    for use, times in made:
        offset = 0
        for length in use:
            out.append((length, ranks[length], ranks[length] + times, sequence, offset))
            ranks[length] += times
            offset += length
        sequence += times
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_: str = "doc_id", text: str = "text", with_ids: bool = True, kept: Written | None = None) -> DataFrame:
    """Pack whole documents into sequences of at most `capacity` tokens.

    Returns id, piece, start, length, ids_crc32, ids (array<int>, if with_ids),
    sequence_id, offset for each piece. Null and empty texts are one token, the
    end. Repeated rows are packed each; an empty table gives no rows.

    Texts are tokenized once into a written table. The driver gets only how many
    pieces have each length (`capacity` sums) and plans on these; each piece
    finds its place by its rank within its length.
    """
    spark = docs.sparkSession
    of = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    found = materialize(arrow(of, _pieces(path, capacity, end, with_ids), schema), kept)
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    slots = spark.createDataFrame(_slots(plan(counts, capacity)), "length long, first long, stop long, sequence long, offset long")
    # a few places for each kind of sequence, of which there are a few for each length
    ranked = numbered(found, ["length"], ["id", "piece", "ids_crc32"], "rank", sum(counts.values()), kept=kept)
    at = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop"))
    slots = F.broadcast(slots.withColumnRenamed("length", "_length"))
    placed = ranked.join(slots, (F.col("length") == F.col("_length")) & at)
    return placed.withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first")).drop("_length", "first", "stop", "sequence", "rank")


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and its ids, from pack(..., with_ids=True); a group has at most `capacity` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packed_documents(documents(spark, sf_dir))


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
