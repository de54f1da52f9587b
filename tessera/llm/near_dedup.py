"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, arrow, documents, drop, materialize, small
from .components import components
from .tokens import ODD, Words, mix, shingle_sets, slices, text_bytes

#: Slots of a signature and rows of a band: 32 bands miss a pair of similarity 0.8 once in 2e7.
SLOTS, ROWS = 128, 4
#: Members that the buckets of one group are compared with, and members of a bucket that is small enough to compare all of them.
HUBS, FEW = 4, 8
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def superminhash(sets: list[np.ndarray], slots: int = SLOTS, most: int = 40_000) -> np.ndarray:
    """SuperMinHash signatures, one row of `slots` values a set; an empty set has EMPTY in all slots.

    Each element walks a random permutation of the slots: at its j-th step it
    offers j plus a random fraction to the j-th slot. A slot keeps the least
    offer. After step j no later offer is below j + 1, so a set is done once all
    its slots hold less. All elements of many sets take a step together.
    """
    out = np.full((len(sets), slots), EMPTY, np.uint64)
    todo: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        nonlocal todo, held
        if not todo:
            return
        owner = np.repeat(np.array([i for i, _ in todo]), [len(s) for _, s in todo])
        element = np.concatenate([s for _, s in todo])
        order = np.broadcast_to(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(element), slots)).copy()
        rows = np.arange(len(element))
        for j in range(slots):
            r = mix(element + np.uint64((j + 1) * int(ODD) & 0xFFFFFFFFFFFFFFFF))
            k = j + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
            at = order[rows, k]
            order[rows, k] = order[:, j]  # the rest of a Fisher-Yates shuffle; column j is not read again
            np.minimum.at(out, (owner, at), (np.uint64(j) << np.uint64(32)) | (r >> np.uint64(32)))
            open_ = np.unique(owner)
            open_ = open_[out[open_].max(axis=1) >= np.uint64(j + 1) << np.uint64(32)]
            if not len(open_):
                break
            if len(stay := np.flatnonzero(np.isin(owner, open_))) < len(owner):
                owner, element, order = owner[stay], element[stay], order[stay]
                rows = np.arange(len(element))
        todo, held = [], 0

    for i, s in enumerate(sets):
        for start in range(0, len(s), most):  # offers of a set's parts meet in its slots
            part = s[start : start + most]
            todo.append((i, part))
            held += len(part)
            if held >= most:
                flush()
    flush()
    return out


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = signatures.shape[1] // rows
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(signatures), bands)).copy()
    for r in range(rows):
        key = mix(key * ODD + signatures[:, r::rows][:, :bands])
    return key


def _signed(k: int, slots: int, rows: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(Words(text_bytes(batch.column("text"))), k)
                keys = band_keys(superminhash(sets, slots), rows)
                one, two = (np.array([int(mix(s ^ np.uint64(x)).sum(dtype=np.uint64)) for s in sets], np.uint64).astype(np.int64) for x in (1, 2))
                flat = pa.array(keys.astype(np.int64).ravel())
                bands = pa.FixedSizeListArray.from_arrays(flat, keys.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two), bands], names=["id", "n", "s1", "s2", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(Words(text_bytes(batch.column("text"))), k)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate([s.astype(np.int64) for s in sets]) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "shingles"])

    return run


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids that reach the similarity on their full sets."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    return pairs.join(one, "a").join(two, "b").filter(100 * both >= percent * (F.size("_x") + F.size("_y") - both)).select("a", "b")


def _hub_pairs(members: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Each bucket's hub with its other members, where sizes allow the similarity."""
    sizes = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
    pairs = members.join(hubs, "bucket").filter((F.col("id") != F.col("hub.id")) & sizes)
    return pairs.select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()


def _still_open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their component, of buckets that hold several components; `held`: members of the bucket."""
    now = members.join(labels, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("label"))
    seen = now.groupBy("bucket").agg(F.min("label").alias("_l"), F.max("label").alias("_m"), F.count(F.lit(1)).alias("held")).filter("_l < _m")
    return now.join(seen.select("bucket", "held"), "bucket")


def _cells(members: DataFrame) -> DataFrame:
    """bucket and cell. Buckets with common members mostly have one cell: the least hash of their members, and of those in buckets that share a member."""
    least = members.groupBy("bucket").agg(F.min(F.xxhash64("id")).alias("_h"))
    mine = members.join(least, "bucket").groupBy("id").agg(F.min("_h").alias("_h"))
    return members.join(mine, "id").groupBy("bucket").agg(F.min("_h").alias("cell"))


def _differences(percent: int):
    """Rows of a cell's members -> what their sets and the cell's centre do not have in common.

    d: how many shingles those are; e: (100 + p) d - (100 - p) n; first: the
    rarest of them as (f, s), where f of the cell's differences have shingle s,
    as many as a similar partner's can need to meet one.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        struct = pa.list_(pa.struct([("f", pa.int64()), ("s", pa.int64())]))
        for batch in batches:
            read = lambda c, i: [x.field(k).to_numpy(zero_copy_only=False) for x in [batch.column(c)[i].values or pa.array([], struct.value_type)] for k in (0, 1)]
            n, size = batch.column("n").to_pylist(), batch.column("size").to_pylist()
            d, first = [], []
            for i in range(batch.num_rows):
                c, s = read("held", i)
                cf, cs = read("centre", i)
                out = 2 * c <= size[i]
                gone = ~np.isin(cs, s[~out], assume_unique=True)
                f, s = np.concatenate([c[out], cf[gone]]), np.concatenate([s[out], cs[gone]])
                order = np.lexsort((s, f))
                most = (100 - percent) * n[i] // percent + 1
                d.append(len(f))
                first.append((f[order[:most]], s[order[:most]]))
            ends = pa.array(np.cumsum([0, *[len(f) for f, _ in first]]), pa.int32())
            flat = [pa.array(np.concatenate([x[k] for x in first] or [np.zeros(0, np.int64)]), pa.int64()) for k in (0, 1)]
            e = [(100 + percent) * x - (100 - percent) * m for x, m in zip(d, n, strict=True)]
            items = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, names=["f", "s"]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("cell", "id", "n", "label")], pa.array(d, pa.int64()), pa.array(e, pa.int64()), items], names=["cell", "id", "n", "label", "d", "e", "first"])

    return run


def _cell_pairs(members: DataFrame, sets: DataFrame, percent: int, kept: Written) -> DataFrame:
    """Pairs of a cell's members that can be similar and have no component in common; no similar pair is left out.

    Sets a and b are similar if at most (1 - t) / (1 + t) of |a| + |b| shingles
    are in one alone. Taking the symmetric difference of both with one and the
    same set, the cell's centre (the shingles that over half of its members
    have), changes nothing of that, and makes members of a group of half-similar
    copies small and unlike each other: what all share is gone. Of these
    differences, two that together are small enough are similar at once, so all
    such members link with the one nearest to the centre. Any other similar
    pair's differences have at least (e_a + e_b) / (2 (100 + p)) shingles in
    common, so they meet within a prefix of each, the rarest shingles first
    (prefix and positional filter). A prefix is the shorter, the further all
    members of other components are from the centre. So members that have only
    the centre in common meet nobody, however many they are.
    """
    share, whole = 100 - percent, 100 + percent
    cells = materialize(_cells(members), kept)
    in_cell = members.select("bucket", "id", "n", "label").join(cells, "bucket").select("cell", "id", "n", "label").distinct()
    in_cell = materialize(in_cell, kept)
    sizes = in_cell.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    ids = in_cell.select("id").distinct()
    of = sets.dropDuplicates(["id"]).join(small(ids, ids.count()), "id", "left_semi")
    each = materialize(in_cell.join(of, "id").select("cell", "id", "n", "label", F.explode("shingles").alias("s")), kept)
    counts = materialize(each.groupBy("cell", "s").agg(F.count(F.lit(1)).alias("c")), kept)
    central = counts.join(sizes, "cell").filter("2 * c > size").select("cell", (F.col("size") - F.col("c")).alias("f"), "s")
    central = materialize(central.groupBy("cell").agg(F.collect_list(F.struct("f", "s")).alias("centre")), kept)
    central = sizes.join(central, "cell", "left")
    held = each.join(counts, ["cell", "s"]).groupBy("cell", "id", "n", "label").agg(F.collect_list(F.struct("c", "s")).alias("held"))
    terms = central.agg(F.sum(1 + F.coalesce(F.size("centre"), F.lit(0)))).first()[0] or 0
    schema = "cell long, id long, n long, label long, d long, e long, first array<struct<f:long,s:long>>"
    far = materialize(arrow(held.join(small(central, terms), "cell").select("cell", "id", "n", "label", "size", "held", "centre"), _differences(percent), schema), kept)
    nearest = far.groupBy("cell").agg(F.min(F.struct("e", "id", "label")).alias("z"))
    far = far.join(small(nearest, nearest.count()), "cell")
    sure = far.filter("e + z.e <= 0 and id <> z.id and label <> z.label").select(F.col("z.id").alias("a"), F.col("id").alias("b"))
    # as these link with the nearest, they have its component
    far = far.withColumn("label", F.when(F.expr("e + z.e <= 0"), F.col("z.label")).otherwise(F.col("label")))
    others = far.filter("label <> z.label").groupBy("cell").agg(F.min("e").alias("_o"))
    far = far.join(small(others, others.count()), "cell")  # a cell without others has nothing left to compare
    reach = F.when(F.col("label") == F.col("z.label"), F.col("_o")).otherwise(F.col("z.e"))
    # of a partner's e: not both at once, of another component, and no further off than its size allows
    least = F.greatest(reach, 1 - F.col("e"), F.col("e") - F.ceil(F.lit(200 * share) * F.col("n") / percent))
    upto = lambda low: F.col("d") - F.ceil((low + F.col("e")) / (2 * whole)) + 1
    rows = far.select("cell", "id", "n", "label", "d", "e", upto(least).alias("_p"), upto(F.greatest(least, "e")).alias("_q"), F.posexplode("first").alias("at", "o"))
    rows = materialize(rows.filter("o.f > 1 and at < _p").select("cell", "o.s", "id", "n", "label", "d", "e", (F.col("at") < F.col("_q")).alias("inner"), "at"), kept)
    x, y = (rows.select("cell", "s", "inner", *[F.col(c).alias(c + i) for c in ("id", "n", "label", "d", "e", "at")]) for i in "xy")
    possible = (
        (F.col("labelx") != F.col("labely"))
        & (F.struct("ex", "idx") < F.struct("ey", "idy"))
        & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
        & (F.col("ex") + F.col("ey") <= 2 * whole * F.least(F.col("dx") - F.col("atx"), F.col("dy") - F.col("aty")))
    )
    met = x.filter("inner").drop("inner").join(y.drop("inner"), ["cell", "s"]).filter(possible)
    return met.select(F.col("idx").alias("a"), F.col("idy").alias("b")).union(sure).distinct()


def link_classes(docs: DataFrame, id_: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, slots: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """The near-duplicate component of each row.

    Args:
        docs: rows with a long id; an id must not name two texts. Repeated rows
            each get their document's row. A null id links with nothing.
        k, percent: words of a shingle; linked from this Jaccard similarity on.

    Rows of equal sets first become one class. Classes that share a band are
    candidates. In each bucket one member is compared with all others; buckets
    of one component then drop out, so a group of near copies costs its size,
    not its square. Small buckets that still hold several components are
    compared in full; members of larger ones by what they have besides their
    group's common text (_cell_pairs). A pair is compared unless it is in one
    component already or can't be similar, and links only on full sets.

    Returns id, n_shingles, component_id (least id reachable; null for a null
    id). Null and empty texts have an empty set and link with nothing.
    """
    spark, kept = docs.sparkSession, Written()
    base = docs.select(F.col(id_).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = materialize(arrow(base, _signed(k, slots, rows), "id long, n long, s1 long, s2 long, bands array<long>"), kept)
    one = signed.select("id", "n", "s1", "s2")
    classes = materialize(one.filter("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("_size")), kept)
    reps = classes.select(F.col("rep").alias("id"))
    done: Written = Written()
    member = signed.join(reps, "id", "left_semi").dropDuplicates(["id"]).select("id", "n", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("bucket")
    shared = materialize(shared, done)  # as a table of its own, it leaves the join free to split a large bucket
    members = materialize(member.join(shared, "bucket").select("bucket", "id", "n"), kept)
    drop(spark, done)
    wanted = materialize(members.select("id").distinct(), done)
    sets = materialize(arrow(base.join(small(wanted, wanted.count()), "id", "left_semi"), _sets(k), "id long, shingles array<long>"), kept)
    # a bucket's hub is its least member by a hash with one of HUBS salts, so buckets of one group have several
    order = F.struct(F.xxhash64("id", F.pmod("bucket", F.lit(HUBS))).alias("h"), "id", "n")
    hubs = materialize(members.groupBy("bucket").agg(F.min(order).alias("hub")), done)
    pairs = materialize(_hub_pairs(members, hubs, percent), done)
    edges = materialize(_similar(pairs, sets, percent), kept)
    labels = materialize(components(edges, done), done)
    open_ = materialize(_still_open(members.join(hubs, "bucket").filter("id <> hub.id").drop("hub"), labels), kept)
    drop(spark, done)
    few, many = open_.filter(F.col("held") <= FEW), open_.filter(F.col("held") > FEW)
    x, y = (few.select("bucket", F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("label").alias(f"l{i}")) for i in "ab")
    in_few = x.join(y, "bucket").filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))).select("a", "b")
    pairs = materialize(in_few.union(_cell_pairs(many, sets, percent, done)).distinct(), kept)
    drop(spark, done)
    edges = materialize(edges.union(_similar(pairs, sets, percent)), kept)
    labels = materialize(components(edges, kept), kept)
    of_class = classes.join(labels, classes["rep"] == labels["id"], "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = one.join(of_class, ["n", "s1", "s2"], "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    found = materialize(out)
    drop(spark, kept)
    return found


def keep_one(docs: DataFrame, id_: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that are near duplicates of a row with a smaller id; a null id is kept.

    Of rows that repeat an id one stays; which, if they differ in other columns, isn't defined.
    """
    found = link_classes(docs, id_, text, k, percent).select(F.col("id").alias("id"), F.col("component_id").alias("c"))
    gone = found.filter("id <> c").select("id").distinct()
    again = found.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    without = lambda of, ids, how: of.join(small(ids, ids.count()), of[id_] == ids["id"], how)
    stay = without(docs, gone, "left_anti")
    return without(stay, again, "left_anti").union(without(stay, again, "left_semi").dropDuplicates([id_]))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component on 4-word shingles at similarity 0.8."""
    out = link_classes(documents(spark, sf_dir), k=4)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
