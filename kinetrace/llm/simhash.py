"""SimHash near-dedup with sharded BK-trees.

1. A fingerprint of each text: bit b is set if over half of the shingle hashes have it.
2. Equal fingerprints become one node. By the pigeonhole principle two fingerprints that differ in at most r bits agree
   on whole blocks when the 64 bits are cut into more than r blocks, so each choice of blocks keys a shard.
3. Each shard is a BK-tree: a child's key is its Hamming distance to the parent, and a lookup follows only edges within
   the radius of the distance it has just measured. Trees of a shard are built and asked in the task that holds it; a
   shard above a size is cut into parts, and the tree of each part is sent to ("broadcast" among) the tasks of all
   parts, so that no task grows with a hot shard and no link is lost.
4. Each task reports a spanning forest of the links it found, never all pairs; components are joined over all shards by
   alternating large-star and small-star rounds, each written to the shared folder.

Null texts count as empty; texts without words have fingerprint zero and are linked like any other. Ties of equal
fingerprints and repeated rows fall in one component. Rows with a null doc_id get a component like others but never
name one unless all of it is null. Long texts are hashed whole. Empty tables give empty results.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batch, documents, ids_and_texts, slices, small_or_shuffled, stored

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Members of one part of a shard, and rows that a task links at once.
PART, AT_ONCE = 4096, 60_000


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned."""
    found = WORDS.findall(text.encode().translate(LOWER))
    if not found:
        return 0
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return sign_bits(np.array([digest(s, seed) for s in shingles], dtype="<u8"))


def sign_bits(h: np.ndarray) -> int:
    """The number whose bits are those set in over half of h."""
    bits = np.zeros(64, dtype=np.int64)
    for start in range(0, len(h), 1 << 16):
        part = h[start : start + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp), fp as a signed long, one row for each row of docs."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for rb in batches:
            for part in slices(rb):
                fps = np.array([fingerprint(t, words) for t in part.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
                yield batch(out, part.column(0), pa.array(fps))

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """BK-trees of many groups at once, in arrays. Groups are numbers from 0 without gaps, in ascending order."""

    def __init__(self, fp: np.ndarray, group: np.ndarray, radius: int):
        self.fp, self.radius, n = fp, radius, len(fp)
        self.root = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        rest = np.setdiff1d(np.arange(n), self.root, assume_unique=True)
        at = self.root[group[rest]]
        while len(rest):
            key = at * 65 + np.bitwise_count(fp[rest] ^ fp[at])
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            new = np.r_[True, key[1:] != key[:-1]]
            first = rest[new][np.cumsum(new) - 1]
            parent[rest[new]], edge[rest[new]] = key[new] // 65, key[new] % 65
            rest, at = rest[~new], first[~new]
        has = np.flatnonzero(parent >= 0)
        self.key = parent[has] * 65 + edge[has]
        order = np.argsort(self.key)
        self.key, self.child = self.key[order], has[order]

    def within(self, fp: np.ndarray, group: np.ndarray, budget: int = 1 << 21):
        """Yields (asked, found): positions of asked fingerprints and of tree nodes of their group within the radius."""
        r, start = self.radius, 0
        while start < len(fp):
            chunk = max(256, min(len(fp) - start, budget // PART))
            ask = np.arange(start, min(len(fp), start + chunk))
            node = self.root[group[ask]]
            start += chunk
            while len(ask):
                d = np.bitwise_count(fp[ask] ^ self.fp[node]).astype(np.int64)
                near = d <= r
                if near.any():
                    yield ask[near], node[near]
                low = np.searchsorted(self.key, node * 65 + np.maximum(d - r, 0))
                size = np.searchsorted(self.key, node * 65 + np.minimum(d + r, 64), side="right") - low
                ask = np.repeat(ask, size)
                node = self.child[np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]


def united(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; roots are the smallest members."""
    while len(a):
        for x in (a, b):
            while (up := parent[x]).tolist() != x.tolist():
                x[:] = up
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _links(fp: np.ndarray, group: np.ndarray, tree: np.ndarray, ask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the members marked ask and those marked tree of each group."""
    fp = fp.view(np.uint64)
    group = np.unique(group, return_inverse=True)[1]
    t, q = np.flatnonzero(tree), np.flatnonzero(ask)
    if not len(t) or not len(q):
        return fp[:0], fp[:0]
    has = np.unique(group[t])
    q = q[np.isin(group[q], has)]
    forest, parent = Forest(fp[t], np.searchsorted(has, group[t]), radius), np.arange(len(fp))
    for a, b in forest.within(fp[q], np.searchsorted(has, group[q])):
        a, b = q[a], t[b]
        other = a != b
        united(parent, a[other], b[other])
    while (up := parent[parent]).tolist() != parent.tolist():
        parent = up
    child = np.flatnonzero(parent != np.arange(len(fp)))
    return fp[child].view(np.int64), fp[parent[child]].view(np.int64)


def shards(nodes: DataFrame, n: int, radius: int) -> DataFrame:
    """choice, bits and the columns of nodes (fp among them): each row once for each choice of blocks that must agree for some pair within the radius."""
    blocks = radius + 1
    while blocks < radius + 5 and n > 1 << (64 * (blocks - radius) // blocks + 6):
        blocks += 1
    cut = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (cut[i + 1] - cut[i])) - 1) << cut[i] for i in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits")))
    return nodes.select("*", F.explode(F.array(*keys)).alias("shard")).select("shard.choice", "shard.bits", *nodes.columns)


def linked(nodes: DataFrame, n: int, radius: int = 3) -> DataFrame:
    """(u, v): links between fingerprints that together connect whatever is within the radius. nodes: distinct fp."""
    members = shards(nodes, n, radius)
    hot = members.groupBy("choice", "bits").count().where(F.col("count") > PART).select("choice", "bits", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    hot = stored(hot, "hot-shards")
    side = small_or_shuffled(hot)
    cold = members.join(side, ["choice", "bits"], "left_anti").select("choice", "bits", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", F.lit(True).alias("tree"), F.lit(True).alias("ask"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    warm = members.join(side, ["choice", "bits"]).select("choice", "bits", "fp", part.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    warm = warm.select("choice", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", (F.col("own") <= F.col("other")).alias("tree"), (F.col("own") >= F.col("other")).alias("ask"))
    key = ["choice", "bits", "i", "j"]
    rows = cold.unionByName(warm).repartition(*key).sortWithinPartitions(*key)

    def run(batches):
        rest = None
        for rb in batches:
            frame = rb.to_pandas()
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if len(frame) < AT_ONCE:
                rest = frame
                continue
            last = (frame[key] == frame[key].iloc[-1]).all(axis=1).to_numpy()
            yield from pairs(frame[~last])
            rest = frame[last].reset_index(drop=True)
        if rest is not None:
            yield from pairs(rest)

    def pairs(frame):
        if len(frame):
            group = (frame[key] != frame[key].shift()).any(axis=1).cumsum().to_numpy()
            u, v = _links(frame.fp.to_numpy().copy(), group, frame.tree.to_numpy(), frame.ask.to_numpy(), radius)
            yield batch(pa.schema([("u", pa.int64()), ("v", pa.int64())]), pa.array(u), pa.array(v))

    return rows.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node that it reaches."""
    turned = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    now, mark = stored(turned(edges).distinct(), "links"), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = turned(large.join(low, "u").select("v", "m").toDF("u", "v")).unionByName(low.toDF("u", "v"))
        now = stored(small.distinct(), "links")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark:
            return now.toDF("node", "root")
        mark = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_dedup(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    n = nodes.count()
    roots = components(linked(nodes.select("fp"), n, radius))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stored(labelled.select("fp", "root").join(ids, "root").select("fp", "component_id"), "components")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """docs, all columns, with one document of each component: the one that names it."""
    return one_of_each(docs, near_dedup(docs, words, radius))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without those that found (doc_id, component_id) names after another document."""
    # Rows without a doc_id have no name to stay by; they stay. Rows that repeat the name of their component are one.
    gone = stored(found.where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("__kt_id")).distinct(), "near-copies")
    rest = docs.join(small_or_shuffled(gone), docs["doc_id"].cast("long") == gone["__kt_id"], "left_anti")
    again = stored(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__kt_id")).count().where("count > 1").select("__kt_id"), "repeated-ids")
    if again.isEmpty():
        return rest
    side = small_or_shuffled(again)
    once = rest.join(side, rest["doc_id"].cast("long") == again["__kt_id"], "left_semi").dropDuplicates(["doc_id"])
    return rest.join(side, rest["doc_id"].cast("long") == again["__kt_id"], "left_anti").unionByName(once)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(documents(spark, sf_dir))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
