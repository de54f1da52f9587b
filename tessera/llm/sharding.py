"""K-d tree sharding: weighted medians along the widest metadata dimension."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, documents, materialize, numbered

#: A key has the coordinate above TIE bits of a hash, so equal coordinates can be cut too.
TIE = 32
BINS = 1024


@dataclass
class Node:
    """A part of the tree that holds `shards` shards, the first of them `first`. An inner node has a cut."""

    first: int
    shards: int
    dim: int = -1
    cut: int = 0
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def place(self, keys: list[Column]) -> Column:
        """The first shard of the leaf that a row with these keys falls into."""
        if self.left is None:
            return F.lit(self.first)
        return F.when(keys[self.dim] <= F.lit(self.cut), self.left.place(keys)).otherwise(self.right.place(keys))


def seated(weights: list[int], shards: int, leaf: float) -> tuple[list[int], list[float]]:
    """The shard of each heavy group, heaviest first into the one with the most room; and what room each shard has left."""
    room = [(-leaf, s) for s in range(shards)]
    heapq.heapify(room)
    at = [0] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        free, at[i] = heapq.heappop(room)
        heapq.heappush(room, (free + weights[i], at[i]))
    left = dict((s, max(0.0, -free)) for free, s in room)
    return at, [left[s] for s in range(shards)]


def _medians(atoms: DataFrame, tree: Node, keys: list[Column], open_: dict[int, Node], stats: dict, exact: float, room: list[float]) -> None:
    """Set the cut of each open node so that the weight at or below it is its left shards' part of the room, within `exact`."""
    todo = {}
    for first, node in open_.items():
        row = stats[first]
        widths = [(row[f"hi{d}"] >> TIE) - (row[f"lo{d}"] >> TIE) for d in range(len(keys))]
        node.dim = max(range(len(keys)), key=lambda d: (widths[d], -d))
        left, whole = (sum(room[first : first + n]) for n in (node.shards // 2, node.shards))
        todo[first] = {"lo": row[f"lo{node.dim}"], "hi": row[f"hi{node.dim}"], "want": row["w"] * left / whole if whole else 0}
    while todo:
        asked = [(f, open_[f].dim, t["lo"], t["hi"], (t["hi"] - t["lo"]) // BINS + 1) for f, t in todo.items()]
        asked = atoms.sparkSession.createDataFrame(asked, "_node int, _dim int, _lo long, _hi long, _step long")
        found = (
            atoms.withColumn("_node", tree.place(keys)).join(F.broadcast(asked), "_node")  # a row for each node
            .select("_node", F.get("_keys", F.col("_dim")).alias("_key"), "_lo", "_hi", "_step", "_w").filter("_key between _lo and _hi")
            .groupBy("_node", F.expr("(_key - _lo) div _step").alias("_bin")).agg(F.sum("_w").alias("_w")).collect()
        )
        for f in list(todo):
            t = todo[f]
            width, below = (t["hi"] - t["lo"]) // BINS + 1, 0
            for b, w in sorted((r["_bin"], r["_w"]) for r in found if r["_node"] == f):
                if below + w >= t["want"]:
                    break
                below += w
            start, end = t["lo"] + b * width, min(t["hi"], t["lo"] + (b + 1) * width - 1)
            if width == 1 or w <= exact:
                open_[f].cut = end if below + w - t["want"] <= t["want"] - below else start - 1
                del todo[f]
            else:
                t |= {"lo": start, "hi": end, "want": t["want"] - below}


def shard(docs: DataFrame, dims: dict[str, Column], weight: Column, group: list[Column], unique: list[str], shards: int | None = None, target_bytes: int | None = None, kept: Written | None = None) -> DataFrame:
    """Deal rows to shards of near equal weight by a k-d tree over metadata.

    Args:
        docs: the rows. It must give the same rows each time it is read.
        dims: name to a number from 0 to 1 for each metadata dimension (null: 0).
        weight: bytes of a row.
        group: expressions; rows equal in all of them stay in one shard, at the
            place of the one with the least `unique` values. Groups of over a
            quarter of a shard are seated first, and the tree fills the room
            that they leave. Only a group of over a whole shard is spread, by a
            hash of `unique`.
        unique: columns that tell rows apart. Rows equal in them too are alike.
        shards, target_bytes: how many leaves, or bytes of a leaf.

    Each level of the tree is a few aggregations to at most BINS sums a node;
    the driver holds only the tree and the heavy groups, of which there are at
    most four a shard. Returns `unique`, weight, shard (int) and
    slot (long, gapless from 0 in each shard). An empty table gives no rows.
    """
    names = list(dims)
    coordinate = lambda c: F.least(F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    base = docs.select(*unique, weight.cast("long").alias("weight"), F.xxhash64(*group).alias("_g1"), F.hash(*group).alias("_g2"), *[F.floor(coordinate(c) * (1 << 29)).alias(f"_{n}") for n, c in dims.items()])
    base = materialize(base, kept)
    total, rows = base.agg(F.sum("weight"), F.count(F.lit(1))).first()
    shards = shards or max(1, -(-(total or 0) // max(1, target_bytes or 1)))
    leaf = max(1.0, (total or 0) / shards)
    key = ["_g1", "_g2"]
    heavy = materialize(base.groupBy(*key).agg(F.sum("weight").alias("_all")).filter(F.col("_all") > leaf / 4), kept)
    whole = heavy.filter(F.col("_all") <= leaf).orderBy(*key).collect()
    seats, room = seated([r["_all"] for r in whole], shards, leaf)
    seats = docs.sparkSession.createDataFrame([(r["_g1"], r["_g2"], s) for r, s in zip(whole, seats, strict=True)], "_g1 long, _g2 int, _seat int")
    over = F.broadcast(heavy.filter(F.col("_all") > leaf).select(*key, F.ceil(F.col("_all") * 16 / leaf).alias("_parts")))  # less than one for each shard
    base = base.join(over, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*unique), F.col("_parts")), F.lit(0))).drop("_parts")
    base = base.join(F.broadcast(seats), key, "left")
    light = base.filter("_seat is null")
    key.append("_part")
    least = F.min(F.struct(*unique, *[f"_{n}" for n in names])).alias("_of")
    atoms = light.groupBy(*key).agg(F.sum("weight").alias("_w"), least)
    tie = F.pmod(F.xxhash64(*key), F.lit(1 << TIE))
    atoms = materialize(atoms.select(*key, "_w", F.array(*[F.col(f"_of._{n}") * F.lit(1 << TIE) + tie for n in names]).alias("_keys")), kept)
    keys = [F.get("_keys", F.lit(d)) for d in range(len(names))]
    tree = Node(0, shards)
    while rows and (open_ := {n.first: n for n in tree.leaves() if n.shards > 1}):
        ends = [f(keys[d]).alias(f"{n}{d}") for d in range(len(names)) for f, n in ((F.min, "lo"), (F.max, "hi"))]
        stats = {r["_node"]: r for r in atoms.groupBy(tree.place(keys).alias("_node")).agg(F.sum("_w").alias("w"), *ends).collect()}
        full = {f: n for f, n in open_.items() if f in stats}
        _medians(atoms, tree, keys, full, stats, leaf / 2000, room)
        for n in open_.values():
            n.dim, half = max(n.dim, 0), n.shards // 2
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.shards - half)
    placed = atoms.select(*key, tree.place(keys).cast("int").alias("shard"))
    out = light.select(*unique, "weight", *key).join(placed, key).drop(*key)
    out = out.unionByName(base.filter("_seat is not null").select(*unique, "weight", F.col("_seat").alias("shard")))
    return numbered(materialize(out, kept), ["shard"], unique, "slot", rows or 0)


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes (law `bytes`).

    Null text counts as empty (16 bytes, crc32 0). Repeated rows each get a slot.
    """
    docs = documents(spark, sf_dir)
    text = F.coalesce(docs["text"], F.lit(""))
    size = (F.octet_length(text) + 16).cast("long")
    by_hash = lambda c: F.pmod(F.xxhash64(docs[c]), F.lit(1 << 20)) / (1 << 20)
    base = docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), by_hash("source").alias("s"), by_hash("lang").alias("l"))
    dims = {"source": F.col("s"), "lang": F.col("l"), "bytes": F.log2(F.col("size")) / 40}
    out = shard(base, dims, F.col("size"), [F.col("h"), F.col("size"), F.col("text_crc32")], ["doc_id", "text_crc32", "size"], shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
