"""MinHash near-dedup: ProbMinHash signatures, banding, verification, classes.

Two documents are linked if their five-word shingles have a similarity of 0.8 or more: the Jaccard similarity of their sets or, with `weighted`, the probability Jaccard similarity of shingles weighted 1 + ln(count). Whichever it is, registers estimate it, bands look for it and verification computes it exactly, so that no step follows another measure than the next. Classes are the connected components of the links.

1. Every text gets a digest of its words (texts equal in that are one node), band hashes and eight bits of each register. Two texts agree in a register with the probability that is their similarity; with all weights 1 (not `weighted`) that is the one of the sets, however often either repeats a passage.
2. Nodes that share a band meet in a bucket. In each, all are verified against one hub, once for each distinct pair; what that links are components.
3. Buckets that still hold more than one component are dealt into blocks of about BLOCK nodes: a component with more than half of that has blocks of its own, the others share blocks. Pairs of blocks, but not those inside one component, are groups: pairs of nodes that belong to different components are compared by their registers, and those whose estimate isn't far below the threshold are verified exactly, unless the group has linked the two already. So a large component with a few strays beside it costs its blocks times the strays', no task holds more than two blocks, no bucket is capped or sampled, copies are never expanded into pairs, and only links that join components leave a group.
4. The components of what both steps linked are the classes.

With 20 bands of 5 registers, a pair at the threshold misses all bands with probability (1 - 0.8^5)^20 = 0.0004; an estimate from 100 registers is more than 0.18 too low with probability below 0.00001.

Components are found by alternating large-star and small-star rounds; each round is written to the shared folder. Where the links are few (counted), the least neighbours are broadcast, so that a hub's links aren't dealt to one task; beyond that adaptive execution splits such joins.

Defined cases: texts without words (null, empty, only marks) are alike only if equal, a null text counting as empty; whole texts are used; repeated rows, and different texts under one doc_id, each get a row, whose class is that of the row's text; a null doc_id takes part and is the smallest of its class only if there is no other; an empty table gives an empty result; other columns are ignored (classes) or pass through (keep_one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import probminhash as pmh
from .common import forget, map_texts, stage

THRESHOLD, ROWS = 0.8, 5
#: Nodes in a block, about; and how far below the threshold an estimate from the registers may fall before a pair is ruled out.
BLOCK, SLACK = 256, 0.18
#: Most doc_ids (8 bytes each) and links (of each of which two nodes' least neighbours, 32 bytes each) that are broadcast; beyond that the rows are shuffled.
BROADCAST_IDS, BROADCAST_LINKS = 1_000_000, 300_000


def sketch(docs: DataFrame, text: str = "text", keep: list[str] | None = None, weighted: bool = False) -> DataFrame:
    """keep (doc_id by default), node (16 bytes), regs (a byte for each register), bands (longs; none for texts without words)."""

    def batch(texts: list[str]) -> dict[str, pa.Array]:
        raw = [t.encode() for t in texts]
        regs, bands, sizes = [], [], []
        for a, b in pmh.batches(raw):
            of, shingle, weight, counts = pmh.weighted_shingles(raw[a:b])
            kept = pmh.signatures(of, shingle, weight if weighted else np.ones(len(of)), b - a)
            regs += [x.tobytes() for x in kept.astype(np.uint8)]
            has = counts > 0
            bands.append(pmh.bands(kept, ROWS)[has].ravel())
            sizes.append(has * (pmh.REGISTERS // ROWS))
        offsets = np.r_[0, np.cumsum(np.concatenate(sizes))] if sizes else np.zeros(1)
        return {"node": pa.array([pmh.word_digest(t) for t in raw], pa.binary()), "regs": pa.array(regs, pa.binary()), "bands": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *bands])))}

    return map_texts(docs, batch, "node binary, regs binary, bands array<bigint>", text, keep or ["doc_id"])


def shingle_sets(docs: DataFrame, text: str = "text", weighted: bool = False) -> DataFrame:
    """node and its shingles (sorted 64-bit numbers, as bytes; if weighted, their weights behind them)."""

    def batch(texts: list[str]) -> dict[str, pa.Array]:
        raw = [t.encode() for t in texts]
        sets = []
        for a, b in pmh.batches(raw):
            of, shingle, weight, _ = pmh.weighted_shingles(raw[a:b])
            cuts = np.searchsorted(of, np.arange(1, b - a))
            sets += [x.tobytes() + (w.tobytes() if weighted else b"") for x, w in zip(np.split(shingle, cuts), np.split(weight, cuts))]
        return {"node": pa.array([pmh.word_digest(t) for t in raw], pa.binary()), "shingles": pa.array(sets, pa.binary())}

    return map_texts(docs, batch, "node binary, shingles binary", text, [])


def similar(a: bytes, b: bytes, threshold: float, weighted: bool = False) -> bool:
    """Whether two nodes of shingle_sets() have a similarity of threshold or more."""
    if weighted:
        (sa, wa), (sb, wb) = ((np.frombuffer(x[: len(x) // 2], np.uint64), np.frombuffer(x[len(x) // 2 :], np.float64)) for x in (a, b))
        return pmh.probability_jaccard(sa, wa, sb, wb) >= threshold - 1e-9
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = np.frombuffer(a + b, np.uint64).copy()
    both.sort()
    n = int((both[1:] == both[:-1]).sum())
    return n >= threshold * (len(both) - n) - 1e-9


def verified(edges: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """Those of edges (a, b) whose nodes are similar enough."""
    pairs = edges.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = [similar(p, q, threshold, weighted) for p, q in zip(x.column("sa").to_pylist(), x.column("sb").to_pylist())]
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) for each node of edges (a, b) but the least ones themselves."""
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
    before = mark(now)
    while before[0]:
        small_enough = F.broadcast if before[0] <= BROADCAST_LINKS else lambda df: df  # a hub's links then stay where they are
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(small_enough(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_enough(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        forget(last)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def block_pairs(met: DataFrame) -> DataFrame:
    """key, node, comp, blk, bi, bj: the nodes of buckets (met: key, node, comp) that hold several components, once for each pair of blocks (bi, bj) that their block blk is in."""
    sizes = met.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n_comp"))
    large = F.col("n_comp") > BLOCK // 2
    keys = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("n_comps"), F.sum(F.when(~large, F.col("n_comp")).otherwise(0)).alias("n_pool"), F.count_if(large).alias("n_large")).where("n_comps > 1")
    sizes = sizes.join(keys, "key")
    # a block is a component (null: the pool of small ones) and a number
    parts = F.when(large, F.ceil(F.col("n_comp") / BLOCK)).otherwise(F.ceil(F.col("n_pool") / BLOCK)).cast("int")
    of_comp = stage(sizes.select("key", "comp", large.alias("large"), parts.alias("parts"), "n_large"), "block-sizes")
    named = lambda comp, part: F.xxhash64(F.coalesce(comp, F.unhex(F.lit(""))), part)
    blocks = of_comp.select("key", F.when(F.col("large"), F.col("comp")).alias("of"), "parts", "n_large").distinct()
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "of", named(F.col("of"), F.col("part")).alias("blk"), "n_large")
    pool, own = blocks.where("of IS NULL").select("key", F.col("blk").alias("b1")), blocks.where("of IS NOT NULL")
    pairs = pool.join(pool.select("key", F.col("b1").alias("b2")), "key").where("b1 <= b2").unionByName(pool.join(own.select("key", F.col("blk").alias("b2")), "key"))
    several = own.where("n_large > 1")
    pairs = pairs.unionByName(several.select("key", F.col("blk").alias("b1"), F.col("of").alias("o1")).join(several.select("key", F.col("blk").alias("b2"), F.col("of").alias("o2")), "key").where("o1 < o2").select("key", "b1", "b2"))
    sides = pairs.withColumn("blk", F.explode(F.array_distinct(F.array("b1", "b2")))).select("key", "blk", F.col("b1").alias("bi"), F.col("b2").alias("bj"))
    part = F.pmod(F.when(F.col("large"), F.xxhash64("node")).otherwise(F.xxhash64("comp")), F.col("parts")).cast("int")
    held = met.join(of_comp.select("key", "comp", "large", "parts"), ["key", "comp"]).select("key", "node", "comp", named(F.when(F.col("large"), F.col("comp")), part).alias("blk"))
    return held.join(sides, ["key", "blk"])


def block_links(x: pa.Table, threshold: float, slack: float, weighted: bool = False) -> pa.Table:
    """Links (a, b: components) between the two blocks of a group (or within the one) that join what isn't joined yet."""
    first, node_block = x.column("bi")[0].as_py(), np.array(x.column("blk"))
    comp = x.column("comp").to_pylist()
    label = np.unique(np.array([c.hex() for c in comp]), return_inverse=True)[1]
    regs = np.stack([np.frombuffer(r, np.uint8) for r in x.column("regs").to_pylist()])
    bands = np.stack([np.asarray(b.values if hasattr(b, "values") else b.as_py(), np.int64) for b in x.column("bands")])
    sets = x.column("shingles").to_pylist()
    key = x.column("key")[0].as_py()
    rows = np.flatnonzero(node_block == first)
    if not len(rows):  # the hash of a block's name can leave it empty
        return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
    others = rows if x.column("bj")[0].as_py() == first else np.flatnonzero(node_block != first)
    parent = list(range(int(label.max()) + 1))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out: list[tuple[bytes, bytes]] = []
    least = (threshold - slack) * regs.shape[1]
    for i in rows.tolist():
        agree = (regs[i] == regs[others]).sum(1)
        for j in others[(agree >= least) & (label[others] != label[i])].tolist():
            if others is rows and j <= i:
                continue
            p, q = root(int(label[i])), root(int(label[j]))
            # a pair counts in the first bucket that it shares
            if p != q and bands[i][np.argmax(bands[i] == bands[j])] == key and similar(sets[i], sets[j], threshold, weighted):
                parent[p] = q
                out.append((comp[i], comp[j]))
    return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})


def classes(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None, weighted: bool = False) -> DataFrame:
    """keep (doc_id by default) of every row, node, and class_id: the least doc_id of its class."""
    keep = keep or ["doc_id"]
    rows = stage(sketch(docs, text, keep, weighted), "sketch")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.any_value("regs").alias("regs"), F.any_value("bands").alias("bands"))
    nodes = stage(nodes, "nodes")
    member = nodes.select("node", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1")
    met = stage(member.join(shared, "key"), "buckets")

    some = nodes.join(met.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("doc_id"), "node")
    ids = some.select("doc_id").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    wanted = docs.select("doc_id", text).join(ids, "doc_id", "left_semi")
    nulls = docs.where(F.col("doc_id").isNull()).select("doc_id", text)
    sets = shingle_sets(wanted.unionByName(nulls), text, weighted).join(some.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = stage(sets, "sets")

    stars = stage(verified(met.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), sets, threshold, weighted), "stars")
    first = components(stars)
    label = F.coalesce("comp", "node")
    met = stage(met.join(first, "node", "left").select("key", "node", label.alias("comp")), "met")
    data = nodes.select("node", "regs", "bands").join(sets, "node")
    left = block_pairs(met).join(data, "node").select("key", "bi", "bj", "blk", "comp", "regs", "bands", "shingles")
    slack = SLACK
    more = left.groupBy("key", "bi", "bj").applyInArrow(lambda x: block_links(x, threshold, slack, weighted), "a binary, b binary")
    second = components(stage(more, "joins")).select(F.col("node").alias("comp"), F.col("comp").alias("top"))

    joined = nodes.select("node", "rep").join(first, "node", "left").select("node", "rep", label.alias("comp"))
    joined = joined.join(second, "comp", "left").select("node", "rep", F.coalesce("top", "comp").alias("comp"))
    least = joined.groupBy("comp").agg(F.min("rep").alias("class_id"))
    of_node = joined.join(least, "comp").select("node", "class_id")
    return rows.select(*keep, "node").join(of_node, "node").select(*keep, "node", "class_id")


def keep_one(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """docs without all but one row of each class: the one with the least doc_id, and of rows that tie in it the one with the least word digest."""
    found = stage(classes(docs, text, threshold, ["doc_id"], weighted), "classes")
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "node", "doc_id")
    kept = found.groupBy("class_id").agg(F.min(order).alias("k")).select("k.doc_id", "k.node")
    rows, ids = found.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).head()
    if rows == ids:
        return docs.join(kept.select("doc_id"), "doc_id", "left_semi")
    # doc_ids repeat (or are null): rows are told apart by their words, and equal ones but for one go
    marked = map_texts(docs.withColumn("_tf_whole", F.col(text)), lambda texts: {"_tf_node": pa.array([pmh.word_digest(t.encode()) for t in texts], pa.binary())}, "_tf_node binary", "_tf_whole", docs.columns)
    same = marked["doc_id"].eqNullSafe(kept["doc_id"]) & (marked["_tf_node"] == kept["node"])
    return marked.join(kept, same, "left_semi").dropDuplicates(["_tf_node"]).select(*docs.columns)
