"""BPE encoding and decoding with a priority queue over a linked list of symbols."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, documents
from .tokens import slices

#: Entries of each word cache in a Python worker; twice as many are held at most.
CACHE_WORDS = 150_000
#: Longer words are not cached.
CACHE_LENGTH = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Cache(dict):
    """A dict that computes missing values and keeps the most recent ones: two generations of at most `most` entries."""

    def __init__(self, compute, most: int = CACHE_WORDS):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= CACHE_LENGTH:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordBPE:
    """The tokenizer of a `tokenizers` JSON file that lower-cases words and marks their ends.

    Read from the file: vocabulary, merges, split pattern, word-end suffix and
    special tokens. Texts are put into NFC and lower case; white space only
    separates words. The file has no decoder, so decoding puts the vocabulary
    strings one after the other with a space between.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()}
        self.suffix: str = model["end_of_word_suffix"]
        self.ranks = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.words = Cache(self.encode_word)
        self.chunks = Cache(self._chunk)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word. The queue holds (rank, place); an entry is stale if its pair is no longer there."""
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.suffix
        ids = [self.vocab[s] for s in symbols]
        ranks, n = self.ranks, len(ids)
        if n == 1:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(found[0], i) for i in range(n - 1) if (found := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            found = ranks.get((ids[i], ids[j]))
            if found is None or found[0] != rank:
                continue
            ids[i], ids[j] = found[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if right := ranks.get((ids[i], ids[k])):
                    heapq.heappush(queue, (right[0], i))
            if (h := before[i]) >= 0 and (left := ranks.get((ids[h], ids[i]))):
                heapq.heappush(queue, (left[0], h))
        return [i for i in ids if i >= 0]

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        """Packed ids and decoded text of a run without white space."""
        text = unicodedata.normalize("NFC", chunk)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # letter by letter: no final sigma
        ids = [i for w in self.split.findall(text) for i in self.words[w]]
        return array("I", ids).tobytes(), self.decode(ids)

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split() takes these for white space; the pattern does not
            return list(map(self.chunks.__getitem__, regex.findall(r"\S+", text)))
        return list(map(self.chunks.__getitem__, text.split()))

    def encode_packed(self, text: str) -> tuple[bytes, str]:
        """Ids of a whole text as unsigned 32-bit integers, and its decoded text."""
        if not any(s in text for s in self.specials):
            parts = self._plain(text)
        else:
            parts = []
            for i, piece in enumerate(self.special.split(text)):
                parts += [(array("I", [self.vocab[piece]]).tobytes(), piece)] if i % 2 else self._plain(piece)
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[0]])

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_packed(text)[0]).tolist()

    def decode(self, ids) -> str:
        return " ".join([self.strings[i] for i in ids])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBPE:
    """One tokenizer, with its cache, for all tasks of a Python worker."""
    return WordBPE(path)


def _encoded(path: str, digest: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = tokenizer(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [bpe.encode_packed(t or "") for t in batch.column("text").to_pylist()]
                counts = pa.array([len(ids) // 4 for ids, _ in found], pa.int64())
                if digest:
                    rest = [pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found]), pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in found])]
                else:
                    rest = [pa.array([array("I", ids).tolist() for ids, _ in found], pa.list_(pa.int64())), pa.array([d for _, d in found])]
                yield pa.RecordBatch.from_arrays([batch.column("id"), counts, *rest], names=["id", "n_tokens", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, id_: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Encode and decode whole texts: id, n_tokens, ids (array<long>), decoded.

    path: a tokenizer file that every executor can open. digest: SHA-256 in hex
    of the packed ids and of the decoded text instead of both. Null and empty
    texts give no ids and an empty text. No shuffle; each row stands alone.
    """
    of = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    kind = "string" if digest else "array<long>"
    return arrow(of, _encoded(path, digest), f"id long, n_tokens long, ids {kind}, decoded string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    import public_tokenizers

    out = encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digest=True)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
