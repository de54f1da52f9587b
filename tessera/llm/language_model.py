"""LM scoring by deleted interpolation of n-gram estimates.

Counts are fetched by batch. Texts are cut into batches of some MB. A batch asks
for the counts of its distinct n-grams: one row for each key bucket, with the
keys and the batch's own counts as packed arrays. Each bucket adds up what it
gets and answers each batch, in the order of its keys. So a frequent n-gram is
one entry per batch, never a row per occurrence, and no task holds more than a
bucket's keys or one batch.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, arrow, bucketed, documents, drop, materialize, pieces
from .tokens import ODD, Words, mix, slices, text_bytes

#: Bytes of text in a batch, about, and keys of a bucket, about.
BATCH, KEYS = 8 << 20, 1_000_000
#: Keys of the end token and of the start, which is only a context.
END, START = np.uint64(0xE4D), np.uint64(0x57A27)
#: Contexts of a count from 2**(b-1) on share the weights of bucket b, up to the last one.
BUCKETS = 20
#: Probabilities are rounded to GRID steps an octave to learn the weights.
GRID, EM_ROUNDS = 4, 40


def _keys(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token, ends of texts included: key of the word, of the word before it, of the pair; and where each text ends."""
    n = len(words.ends)
    ends = words.ends + np.arange(1, n + 1)
    word = np.empty(len(words.ids) + n, np.uint64)
    last = np.zeros(len(word), bool)
    last[ends - 1] = True
    word[~last] = mix(words.vocab[words.ids])
    word[last] = END
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.r_[0, ends[:-1]][: n]] = START
    return word, before, _pair(before, word), ends


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of pairs. 56 bits tell the pairs of a corpus apart well enough and pack in a byte less."""
    return mix(before * ODD + word) & ~np.uint64(0xFF)


def _distinct(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their training counts, and the place of each key."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    new = np.r_[True, sorted_[1:] != sorted_[:-1]] if len(keys) else np.zeros(0, bool)
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return sorted_[new], np.bincount(at, train, int(new.sum())).astype(np.int64), at


@dataclass
class Batch:
    """The n-grams of a batch of texts: tokens' places in its sorted distinct word and pair keys."""

    words: np.ndarray
    pairs: np.ndarray
    word_count: np.ndarray
    pair_count: np.ndarray
    word_at: np.ndarray
    before_at: np.ndarray  # -1: start
    pair_at: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], train: np.ndarray) -> Batch:
        word, before, pair, ends = _keys(Words(texts))
        sizes = np.diff(np.r_[0, ends])
        each = np.repeat(train, sizes).astype(np.float64)
        words, word_count, word_at = _distinct(word, each)
        pairs, pair_count, pair_at = _distinct(pair, each)
        before_at = np.empty_like(word_at)
        before_at[1:] = word_at[:-1]
        before_at[np.r_[0, ends[:-1]][: len(ends)]] = -1
        return cls(words, pairs, word_count, pair_count, word_at, before_at, pair_at, ends)


def _pack(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x.astype(kind)).tobytes()


def _planes(x: np.ndarray) -> bytes:
    """Integers as compressed planes of their bytes, of which the upper ones are nearly all zero."""
    import zstandard

    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view("u1").reshape(-1, x.itemsize).T).tobytes())


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, "<u8"), dtype=np.uint64)


def _batches(learn: str):
    """Rows of one batch each: its texts' ids, flags, ends and words. `learn` is a boolean column."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text", BATCH):
                texts = text_bytes(batch.column("text"))
                train = np.array(batch.column(learn).to_pylist(), bool)
                b = Batch.of(texts, train)
                ids = batch.column("id")
                flags = train | ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8) << 1
                row = {
                    "part": part, "batch": part << 32 | number, "keys": len(b.words) + len(b.pairs), "learned": int(train.sum()),
                    "ids": _planes(ids.fill_null(0).to_numpy()), "flags": _pack(flags, "u1"), "ends": _planes(b.ends.astype("<i8")), "word_at": _planes(b.word_at.astype("<u4")), "words": _pack_keys(b.words),
                }
                number += 1
                yield pa.RecordBatch.from_pylist([row], pa.schema([(c, pa.int64()) for c in ("part", "batch", "keys", "learned")] + [(c, pa.binary()) for c in ("ids", "flags", "ends", "word_at", "words")]))

    return run


BATCH_SCHEMA = "part long, batch long, keys long, learned long, ids binary, flags binary, ends binary, word_at binary, words binary"


def _read(row: dict) -> tuple[Batch, np.ma.MaskedArray, np.ndarray]:
    """The batch of a row again, its ids (null: masked) and training flags."""
    words, at, ends = _unpack_keys(row["words"]), _from_planes(row["word_at"], "<u4").astype(np.int64), _from_planes(row["ends"], "<i8")
    flags = np.frombuffer(row["flags"], "u1")
    train, ids = flags & 1 > 0, np.ma.array(_from_planes(row["ids"], "<i8"), mask=flags & 2 > 0)
    word = words[at]
    before_at = np.empty_like(at)
    before_at[1:] = at[:-1]
    first = np.r_[0, ends[:-1]][: len(ends)]
    before_at[first] = -1
    before = np.where(before_at < 0, START, words[before_at])
    each = np.repeat(train, np.diff(np.r_[0, ends])).astype(np.float64)
    pairs, pair_count, pair_at = _distinct(_pair(before, word), each)
    b = Batch(words, pairs, np.bincount(at, each, len(words)).astype(np.int64), pair_count, at, before_at, pair_at, ends)
    return b, ids, train


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of keys, so sorted keys stay in order through them."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _ask(buckets: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in batch.to_pylist():
                b, _, _ = _read(row)
                for kind, keys, counts in ((0, b.words, b.word_count), (1, b.pairs, b.pair_count)):
                    of = _bucket_of(keys, buckets)
                    cut = np.searchsorted(of, np.arange(buckets + 1))
                    some = np.flatnonzero(np.diff(cut))
                    part = [(int(k), _pack_keys(keys[cut[k] : cut[k + 1]]), squeeze.compress(_pack(counts[cut[k] : cut[k + 1]], "<u4"))) for k in some]
                    yield pa.RecordBatch.from_arrays([pa.array([2 * p[0] + kind for p in part], pa.int64()), pa.array([row["batch"]] * len(part), pa.int64()), pa.array([p[1] for p in part], pa.binary()), pa.array([p[2] for p in part], pa.binary())], names=["bucket", "batch", "keys", "counts"])

    return run


def _answer(table):
    """For one bucket: the summed count of each asked key, and for words how many keys and tokens there are in training."""
    import pyarrow as pa
    import zstandard

    squeeze, open_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor().decompress
    keys = [_unpack_keys(k) for k in table.column("keys").to_pylist()]
    counts = [np.frombuffer(open_(c), "<u4") for c in table.column("counts").to_pylist()]
    cut = np.cumsum([0, *map(len, keys)])
    distinct, total, at = _distinct(np.concatenate(keys), np.concatenate(counts).astype(np.float64))
    found = total[at]
    bucket = table.column("bucket")[0].as_py()
    n = len(keys)
    first = [1] + [0] * (n - 1)
    types, tokens = (int((total > 0).sum()), int(total.sum())) if bucket % 2 == 0 else (0, 0)
    return pa.table({
        "bucket": pa.array([bucket] * n, pa.int64()), "batch": table.column("batch"), "found": pa.array([squeeze.compress(_pack(found[a:b], "<u8")) for a, b in zip(cut, cut[1:])], pa.binary()),
        "types": pa.array([types * f for f in first], pa.int64()), "tokens": pa.array([tokens * f for f in first], pa.int64()),
    })


def _with_totals(left, right) -> Iterator[dict]:
    """A part's batches, each with the summed counts of all its words and pairs."""
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    answers = defaultdict(list)
    for bucket, batch, found in zip(*(right.column(c).to_pylist() for c in ("bucket", "batch", "found")), strict=True):
        answers[batch].append((bucket, found))
    for i in range(left.num_rows):
        row = left.slice(i, 1).to_pylist()[0]
        parts = sorted(answers.pop(row["batch"]))
        for kind, name in enumerate(("word_total", "pair_total")):
            row[name] = np.frombuffer(b"".join([open_(f) for b, f in parts if b % 2 == kind]), "<u8").astype(np.float64)
        yield row


def _estimates(row: dict, docs: int, tokens: int, types: int, delete: bool):
    """Per token: bucket of the context's count, estimates from pair, word and nothing; with the batch, ids, flags and word counts.

    delete: take each token itself out of the counts, as held-out counts are.
    """
    b, ids, train = _read(row)
    c_word, c_pair = row["word_total"][b.word_at], row["pair_total"][b.pair_at]
    c_before = np.where(b.before_at < 0, float(docs), row["word_total"][b.before_at])
    off = 1.0 if delete else 0.0
    context = np.maximum(c_before - off, 0)
    bucket = np.minimum(np.ceil(np.log2(context + 1)), BUCKETS - 1).astype(np.int64)
    p2 = np.where(context > 0, np.maximum(c_pair - off, 0) / np.maximum(context, 1), 0)
    p1 = np.maximum(c_word - off, 0) / max(tokens - off, 1)
    return b, ids, train, c_word, bucket, p2, p1, 1 / (types + 1)


def _level(p: np.ndarray) -> np.ndarray:
    """The step of a probability on a grid of GRID steps an octave; 0 for none."""
    return np.where(p > 0, np.minimum(1 + np.round(-np.log2(np.maximum(p, 1e-300)) * GRID), 1023), 0).astype(np.int64)


def learn_weights(cells: np.ndarray, flat: float, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights of pair, word and flat estimate for each context bucket, by expectation-maximisation.

    cells: rows of bucket, level of the pair's and of the word's estimate, tokens.
    Buckets without tokens keep the word and flat estimate's even weights.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not len(cells):
        weights[:] = [0, 0.5, 0.5]
        return weights
    bucket, n = cells[:, 0], cells[:, 3].astype(np.float64)
    p = [np.where(x > 0, 2.0 ** (-(x - 1) / GRID), 0) for x in (cells[:, 1], cells[:, 2])]
    p = np.stack([*p, np.full(len(n), flat)], axis=1)
    seen = np.bincount(bucket, n, BUCKETS)
    for _ in range(rounds):
        part = weights[bucket] * p
        part *= (n / part.sum(axis=1))[:, None]
        new = np.stack([np.bincount(bucket, part[:, k], BUCKETS) for k in range(3)], axis=1)
        weights = np.where(seen[:, None] > 0, new / np.maximum(seen, 1)[:, None], [0, 0.5, 0.5])
    # the flat estimate keeps a little weight, so that no text has probability 0
    weights = np.maximum(weights, [0, 0, 1e-6])
    return weights / weights.sum(axis=1, keepdims=True)


def model_scores(docs: DataFrame, train, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The log10 probability of each whole text under a bigram model with deleted interpolation.

    P(w|v) = a c(v w)/c(v) + b c(w)/N + d/(V+1), where a, b, d depend on the
    bucket of c(v), over words and one end token a text; counts come from the
    rows where `train` (a boolean column) holds. The weights are learned by EM
    on held-out counts: each training token is scored with itself taken out of
    the counts. Words are known by 64-bit hashes.

    Returns id, train, n_tokens, n_known, train_tokens, base_score (add-one
    unigram) and score. Null and empty texts are one end token. Repeated rows
    count and are scored each, a null id stays null; without training rows all
    counts are 0, and an empty table gives no rows.
    """
    spark, kept = docs.sparkSession, Written()
    of = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("learn"))
    # the batches of a task stay together in one bucket, so they are never shuffled: only answers move to them
    held = bucketed(arrow(of, _batches("learn"), BATCH_SCHEMA), "part", kept)
    keys, lines = (x or 0 for x in held.agg(F.sum("keys"), F.sum("learned")).first())
    buckets = pieces(keys, 2 * KEYS, 48)
    asked = arrow(held, _ask(buckets), "bucket long, batch long, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "bucket long, batch long, found binary, types long, tokens long")
    answers = materialize(answers.withColumn("part", F.shiftright("batch", 32)), kept)
    types, tokens = (x or 0 for x in answers.agg(F.sum("types"), F.sum("tokens")).first())
    joined = held.groupBy("part").cogroup(answers.select("part", "bucket", "batch", "found").groupBy("part"))

    def cells(left, right):
        import pyarrow as pa

        seen = Counter()
        for row in _with_totals(left, right):
            b, _, flags, _, bucket, p2, p1, _ = _estimates(row, lines, tokens, types, True)
            use = np.repeat(flags, np.diff(np.r_[0, b.ends]))
            code, n = np.unique(bucket[use] << 20 | _level(p2[use]) << 10 | _level(p1[use]), return_counts=True)
            seen.update(dict(zip(code.tolist(), n.tolist(), strict=True)))
        return pa.table({"cell": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    # at most BUCKETS x 1024 x 1024 cells, of which a few thousand occur, however large the corpus
    found = joined.applyInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    table = np.array(sorted((r["cell"] >> 20, r["cell"] >> 10 & 1023, r["cell"] & 1023, r["n"]) for r in found), np.int64).reshape(-1, 4)
    weights = learn_weights(table, 1 / (types + 1))

    def score(left, right):
        import pyarrow as pa

        out = []
        for row in _with_totals(left, right):
            b, ids, flags, c_word, bucket, p2, p1, flat = _estimates(row, lines, tokens, types, False)
            w = weights[bucket]
            logs = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * flat)
            base = np.log10((c_word + 1) / (tokens + types + 1))
            starts = np.r_[0, b.ends[:-1]][: len(b.ends)]
            add = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]
            columns = [pa.array(ids.data, mask=ids.mask), pa.array(flags), pa.array(np.diff(np.r_[0, b.ends])), pa.array(add((c_word > 0).astype(np.int64))), pa.array(np.full(len(ids), tokens, np.int64)), pa.array(add(base)), pa.array(add(logs))]
            out.append(pa.Table.from_arrays(columns, names=["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    out = materialize(joined.applyInArrow(score, "id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    drop(spark, kept)
    return out


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of those whose crc32(doc_id as text) mod 7 is not 2."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = model_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    return out.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
