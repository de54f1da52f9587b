"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, documents
from .tokens import slices, text_bytes

#: Filters see WIDTH bytes at every STRIDE-th place; a chunk of CHUNK bytes starts every STEP bytes.
WIDTH, STRIDE, CHUNK, STEP = 8, 4, 256, 240
EMBED, FILTERS = 4, 24
#: Labelled rows of each class to fit on, at most; chunks of a step's texts that are held at once, and texts of a step.
FIT_ROWS, FIT_HELD, FIT_TEXTS = 1000, 2048, 64


@dataclass
class ByteConvNet:
    """Embedded bytes -> filters -> ReLU -> maximum over each chunk -> mean and maximum over chunks -> logistic."""

    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    shift: float

    @classmethod
    def start(cls, seed: int = 1) -> ByteConvNet:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.5, (256, EMBED)).astype(np.float32), r.normal(0, 0.25, (WIDTH * EMBED, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), r.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)

    def activations(self, data: np.ndarray) -> np.ndarray:
        """The filters at every STRIDE-th place; data has a length of WIDTH at least, by STRIDE."""
        x = self.embed[data]
        n = (len(data) - WIDTH) // STRIDE + 1
        windows = np.lib.stride_tricks.as_strided(x, (n, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))
        return np.ascontiguousarray(windows) @ self.filters

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of FILTERS maxima for all chunks of whole texts, and how many each text has.

        Texts are padded with zero bytes and laid end to end. Chunks overlap by
        `lap` places, so each is cut into a head of that length and the rest,
        and takes the next one's head too.
        """
        cell, lap = STEP // STRIDE, (CHUNK - WIDTH) // STRIDE + 1 - STEP // STRIDE
        sizes = np.array([max(-(-len(t) // STRIDE) * STRIDE, WIDTH + lap * STRIDE) for t in texts])
        data = np.frombuffer(b"".join([t.ljust(n, b"\0") for t, n in zip(texts, sizes.tolist(), strict=True)]) + bytes(WIDTH), np.uint8)
        first = np.cumsum(sizes) // STRIDE - sizes // STRIDE
        places = (sizes - WIDTH) // STRIDE + 1
        chunks = np.maximum(1, -(-(places - lap) // cell))
        act = self.activations(data)
        for gap in range(WIDTH // STRIDE - 1):
            act[first + places + gap] = -np.inf  # these would see two texts
        ends = np.cumsum(chunks)
        within = np.arange(ends[-1]) - np.repeat(ends - chunks, chunks)
        starts = np.repeat(first, chunks) + within * cell
        parts = np.maximum.reduceat(act[: int(sizes.sum()) // STRIDE], np.stack([starts, starts + lap], axis=1).ravel(), axis=0)
        heads = parts[::2]
        rows = np.maximum(heads, parts[1::2])
        more = np.ones(len(rows), bool)
        more[ends - 1] = False
        at = np.flatnonzero(more)
        rows[at] = np.maximum(rows[at], heads[at + 1])
        return np.maximum(rows + self.bias, 0), chunks

    def scores(self, texts: list[bytes], most: int = 1 << 20) -> list[float]:
        """The probability of label 1 for each text. Longer texts than `most` bytes are pooled in parts that share a chunk's overlap."""
        step = most // STEP * STEP
        cut = [[t[s : s + step + CHUNK - STEP] for s in range(0, max(1, len(t) - CHUNK + STEP), step)] for t in texts]
        flat = [c for cs in cut for c in cs]
        rows, counts, at = [], [], 0
        while at < len(flat):
            end, held = at, 0
            while end < len(flat) and (end == at or held + len(flat[end]) <= most):
                held += len(flat[end])
                end += 1
            r, c = self.pooled(flat[at:end])
            rows.append(r)
            counts.append(c)
            at = end
        if not rows:
            return []
        pool, count = np.concatenate(rows), np.concatenate(counts)
        parts = np.r_[0, np.cumsum([len(c) for c in cut])[:-1]]
        count = np.add.reduceat(count, parts)
        starts = np.r_[0, np.cumsum(count)[:-1]]
        mean, high = np.add.reduceat(pool, starts, axis=0) / count[:, None], np.maximum.reduceat(pool, starts, axis=0)
        z = np.concatenate([mean, high], axis=1).astype(np.float64) @ self.out.astype(np.float64) + self.shift
        return (1 / (1 + np.exp(-np.clip(z, -40, 40)))).tolist()


def _own(texts: list[bytes], count: np.ndarray) -> np.ndarray:
    """How many filter places of each chunk lie in its text, padded as pooled() pads it; those behind see only zero bytes."""
    most = (CHUNK - WIDTH) // STRIDE + 1
    least = WIDTH + (most - STEP // STRIDE) * STRIDE
    size = np.array([max(-(-len(t) // STRIDE) * STRIDE, least) for t in texts])
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.minimum(most, (np.repeat(size, count) - within * STEP - WIDTH) // STRIDE + 1)


def _best(net: ByteConvNet, data: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each chunk and filter the place of the maximum among the chunk's own, as a byte's offset; chunks by FILTERS."""
    out = np.empty((len(data), FILTERS), np.int32)
    n = (CHUNK - WIDTH) // STRIDE + 1
    for at in range(0, len(data), 256):
        x = net.embed[data[at : at + 256]].reshape(-1, CHUNK * EMBED)
        win = np.lib.stride_tricks.as_strided(x, (len(x), n, WIDTH * EMBED), (x.strides[0], STRIDE * EMBED * 4, 4))
        act = (win.reshape(-1, WIDTH * EMBED) @ net.filters).reshape(len(x), n, FILTERS)
        act[np.arange(n) >= own[at : at + 256, None]] = -np.inf
        out[at : at + 256] = act.argmax(axis=1) * STRIDE
    return out


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of the texts as rows of CHUNK bytes, and how many each text has."""
    starts = [range(0, max(1, len(t) - CHUNK + STEP), STEP) for t in texts]
    data = np.zeros((sum(map(len, starts)), CHUNK), np.uint8)
    row = 0
    for t, of in zip(texts, starts, strict=True):
        for s in of:
            c = t[s : s + CHUNK]
            data[row, : len(c)] = np.frombuffer(c, np.uint8)
            row += 1
    return data, np.array([len(of) for of in starts])


def fit(texts: list[bytes], labels: list[int], prior: float, epochs: int = 12, rate: float = 0.01, seed: int = 1) -> ByteConvNet:
    """Fit a network on whole texts, by Adam, with both classes weighted alike; then shift to `prior`.

    Each step sees all chunks of its texts. They are gone through in parts of
    FIT_HELD chunks, twice: first for the pooled values, then for the gradient,
    which comes only from the place of each chunk's maximum.
    """
    net = ByteConvNet.start(seed)
    r = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    params = [net.embed, net.filters, net.bias, net.out, np.zeros(1, np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for at in range(0, len(order), FIT_TEXTS):
            part = order[at : at + FIT_TEXTS]
            chosen = [texts[i] for i in part]
            data, count = chunked(chosen)
            owner = np.repeat(np.arange(len(part)), count)
            best = _best(net, data, _own(chosen, count))
            held = [slice(a, a + FIT_HELD) for a in range(0, len(data), FIT_HELD)]
            where_at = lambda h: best[h][:, :, None] + np.arange(WIDTH)
            bytes_at = lambda h: np.take_along_axis(data[h], where_at(h).reshape(len(data[h]), -1), 1)
            picked_at = lambda seen: net.embed[seen].reshape(len(seen), FILTERS, WIDTH * EMBED)
            top = np.concatenate([np.einsum("ckw,wk->ck", picked_at(bytes_at(h)), net.filters) for h in held]) + net.bias
            pool = np.maximum(top, 0)
            starts = np.r_[0, np.cumsum(count)[:-1]].astype(int)
            mean = np.add.reduceat(pool, starts) / count[:, None]
            high = np.maximum.reduceat(pool, starts)
            f = np.concatenate([mean, high], axis=1).astype(np.float32)
            z = f @ net.out + params[4][0]
            g = ((1 / (1 + np.exp(-z)) - y[part]) * weight[part] / len(part)).astype(np.float32)
            d_f = g[:, None] * net.out
            d_pool = d_f[owner, :FILTERS] / count[owner, None]
            where = pool == high[owner]
            d_pool = d_pool + d_f[owner, FILTERS:] * where / np.maximum(np.add.reduceat(where.astype(np.float32), starts), 1)[owner]
            d_top = (d_pool * (top > 0)).astype(np.float32)
            d_filters, d_embed = np.zeros_like(net.filters), np.zeros((256, EMBED))
            for h in held:
                seen = bytes_at(h)
                d_filters += np.einsum("ck,ckw->wk", d_top[h], picked_at(seen))
                d_win = d_top[h][:, :, None] * net.filters.T[None]
                d_embed += np.stack([np.bincount(seen.ravel(), d, 256) for d in d_win.reshape(-1, EMBED).T], axis=1)
            step += 1
            for p, grad, a, b in zip(params, (d_embed, d_filters, d_top.sum(axis=0), f.T @ g, np.array([g.sum()], np.float32)), m, v, strict=True):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad**2 - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)
    net.shift = float(params[4][0]) + float(np.log(prior / (1 - prior)))
    return net


def train(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", label: str = "quality", text: str = "text", rows: int = FIT_ROWS) -> ByteConvNet | float:
    """Fit on at most `rows` labelled documents of each class, the first by a hash of the id, with their whole texts.

    The class shares come from all labels. Labels other than 0 and 1 are left
    out. With labels of one class or none, gives their constant share (0.5).
    """
    known = labels.select(F.col(id_).cast("long").alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(count) < 2:
        return float(next(iter(count), 0.5))
    first = [known.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(rows) for c in (0, 1)]
    of = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    picked = of.join(F.broadcast(first[0].union(first[1]).dropDuplicates(["id"])), "id")  # 2 * rows ids at most
    found = picked.groupBy("id").agg(F.first("label").alias("label"), F.max("text").alias("text")).orderBy("id").limit(2 * rows).toArrow()
    prior = count[1] / (count[0] + count[1])
    marks = found.column("label").to_pylist()
    if len(set(marks)) < 2:
        return prior
    return fit(text_bytes(found.column("text")), marks, prior)


def score(docs: DataFrame, model: ByteConvNet | float, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id and score (0 to 1) of every whole text; null counts as empty. Each row stands alone; no shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, "text"):
                texts = text_bytes(batch.column("text"))
                scores = [model] * len(texts) if isinstance(model, float) else model.scores(texts)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    return arrow(docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("text")), run, "id long, score double")


def keep_good(docs: DataFrame, model: ByteConvNet | float, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs whose whole text scores `threshold` or more, with all their columns."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, text):
                texts = text_bytes(batch.column(text))
                scores = [model] * len(texts) if isinstance(model, float) else model.scores(texts)
                yield batch.filter(pa.array([s >= threshold for s in scores], pa.bool_()))

    return arrow(docs, run, docs.schema)


def is_held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 5 == 0


def fitted(spark: SparkSession, sf_dir: str) -> ByteConvNet | float:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return train(documents(spark, sf_dir), labels.filter(~is_held_out()))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from the labels that are not held out."""
    out = score(documents(spark, sf_dir), fitted(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), is_held_out("id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
