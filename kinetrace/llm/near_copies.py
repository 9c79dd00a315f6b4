"""Near copies for the pipeline: SimHash candidates by sharded BK-trees (op4's), confirmed by five-word shingles.

1. A text is the set of its distinct shingles of five words; equal sets are one node. Its fingerprint is the SimHash of
   its distinct words: a changed word alters up to five shingles but one word, so texts whose shingles are 0.8 alike
   differ in few bits. (Among 45 such pairs of sf0.1 7 bits or fewer: 44; by fingerprints of the shingles: 16.)
2. Nodes whose fingerprints are within RADIUS share a shard (see simhash). Each shard's BK-tree gives a spanning forest of its
   pairs, never all of them; their components are the groups, so that two nodes within RADIUS are in one group.
3. In each group all whole sets are compared, by a product of 0/1 matrices in the task that holds them; pairs of at least SIMILARITY
   are links, and the task reports a spanning forest of them. Components of the links are the near copies.
A shard or group above a size is cut into parts, and each pair of parts is a task's, so that no task grows with a large one
and no pair is lost.

Null and empty texts have the empty set and are alike. Rows with a null doc_id get a component but never name one unless
all of it is null; repeated rows fall in one component. Extra columns of any name are kept by keep_one. An empty table
gives an empty result. Texts are hashed whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch, ids_and_texts, slices, small_or_shuffled, stored
from .simhash import AT_ONCE, LOWER, PART, WORDS, Forest, components, one_of_each, shards, sign_bits, united

SIMILARITY, RADIUS = 0.8, 7
#: Pairs that a task measures at once.
MEASURED = 1 << 18
#: Shingles by which a task compares sets at once.
COLUMNS = 4096
#: Members of a group whose sets a task compares with as many others.
NAMED = 256


def words_of(text: str) -> list[bytes]:
    return WORDS.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))


def shingles(found: list[bytes], words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words none."""
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(found) <= words:
        each = [b" ".join(found)]
    else:
        each = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, 42) for s in each], dtype=np.uint64))


def fingerprint(found: list[bytes]) -> int:
    """SimHash of the distinct words, unsigned."""
    digest = xxhash.xxh64_intdigest
    return sign_bits(np.array([digest(w, 42) for w in set(found)], dtype="<u8")) if found else 0


def node(found: np.ndarray) -> int:
    """The name of a set of shingles, signed."""
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), 42)], dtype=np.uint64).view(np.int64)[0])


def signature(text: str, words: int) -> tuple[int, int]:
    """The name of the text's set of shingles, and its fingerprint, unsigned."""
    found = words_of(text)
    return node(shingles(found, words)), fingerprint(found)


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, node, fp), one row for each row of docs."""
    out = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for rb in batches:
            for part in slices(rb, 2 << 20):
                names, fps = zip(*(signature(x.as_py(), words) for x in part.column(1)), strict=True)
                yield batch(out, part.column(0), names, pa.array(np.array(fps, dtype=np.uint64).view(np.int64)))

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, node long, fp long")


def spanning(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members and the roots that they hang on; leaves parent flat."""
    while not np.array_equal(up := parent[parent], parent):
        parent[:] = up
    child = np.flatnonzero(parent != np.arange(len(parent)))
    return child, parent[child]


def near_links(fp: np.ndarray, group: np.ndarray, tree: np.ndarray, ask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (positions) of all pairs of an asking and a tree member of one group within the radius."""
    group = np.unique(group, return_inverse=True)[1]
    t, q = np.flatnonzero(tree), np.flatnonzero(ask)
    if not len(t) or not len(q):
        return t[:0], t[:0]
    has = np.unique(group[t])
    q = q[np.isin(group[q], has)]
    forest, at, parent = Forest(fp[t], np.searchsorted(has, group[t]), radius), np.searchsorted(has, group), np.arange(len(fp))
    pairs = np.cumsum(np.bincount(at[t], minlength=len(has))[at[q]])
    start = 0
    while start < len(q):
        stop = max(start + 1, int(np.searchsorted(pairs, (pairs[start - 1] if start else 0) + MEASURED, side="right")))
        own, start = q[start:stop], stop
        for a, b in forest.within(fp[own], at[own]):
            a, b = parent[own[a]], parent[t[b]]
            apart = a != b
            if apart.any():
                united(parent, a[apart], b[apart])
                spanning(parent)
    return spanning(parent)


def grouped(rows: DataFrame, key: list[str], name: str, part: int) -> DataFrame:
    """rows with i, j, tree, ask, dealt and sorted by key, i, j: each member of tree meets each of ask. Keys of more than part rows are cut,
    each pair (i, j) of parts in a task of its own. name: the column that members are cut by."""
    hot = rows.groupBy(*key).count().where(F.col("count") > part).select(*key, F.ceil(F.col("count") / part).cast("int").alias("parts"))
    side = small_or_shuffled(stored(hot, "hot-groups"))
    every = [*rows.columns, "i", "j", "tree", "ask"]
    cold = rows.join(side, key, "left_anti").select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("tree"), F.lit(True).alias("ask")).select(every)
    warm = rows.join(side, key).withColumn("own", F.pmod(F.xxhash64(name), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    warm = warm.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("tree"), (F.col("own") >= F.col("other")).alias("ask")).select(every)
    key = [*key, "i", "j"]
    return cold.unionByName(warm).repartition(*key).sortWithinPartitions(*key)


def candidates(members: DataFrame, radius: int, part: int) -> DataFrame:
    """(u, v): pairs of nodes that together connect whatever is within the radius. members: choice, bits, node, fp."""
    key = ["choice", "bits", "i", "j"]
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

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
            group, name = (frame[key] != frame[key].shift()).any(axis=1).cumsum().to_numpy(), frame.node.to_numpy()
            u, v = near_links(frame.fp.to_numpy().view(np.uint64), group, frame.tree.to_numpy(), frame.ask.to_numpy(), radius)
            yield batch(out, pa.array(name[u]), pa.array(name[v]))

    return grouped(members, ["choice", "bits"], "node", part).mapInArrow(run, "u long, v long").distinct()


def whole_sets(docs: DataFrame, nodes: DataFrame, words: int = 5) -> DataFrame:
    """(node, found): the shingles of one document of each of nodes (node, least)."""
    out = pa.schema([("node", pa.int64()), ("found", pa.binary())])
    side = small_or_shuffled(stored(nodes.select(F.col("least").alias("__kt_id")).distinct(), "least"))
    plain = ids_and_texts(docs)

    def run(batches):
        for rb in batches:
            for part in slices(rb, 2 << 20):
                found = [shingles(words_of(t), words) for t in part.column(1).to_pylist()]
                yield batch(out, [node(f) for f in found], [f.tobytes() for f in found])

    return plain.join(side, F.col("doc_id").eqNullSafe(F.col("__kt_id")), "left_semi").select("doc_id", "text").mapInArrow(run, "node long, found binary").dropDuplicates(["node"])


def alike(found: list[np.ndarray], tree: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (positions) of the pairs of an asking and a tree member whose sets are at least SIMILARITY alike."""
    size, parent = np.array([len(f) for f in found]), np.arange(len(found))
    each, holders = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)[1:]
    shared = holders > 1
    own, col = np.repeat(parent, size)[shared[each]], (np.cumsum(shared) - 1)[each[shared[each]]]
    order = np.argsort(col, kind="stable")
    own, col = own[order], col[order]
    t, q, both = np.flatnonzero(tree), np.flatnonzero(ask), 0
    for start in range(0, int(shared.sum()), COLUMNS):
        low, high = np.searchsorted(col, [start, start + COLUMNS])
        holds = np.zeros((len(found), min(COLUMNS, int(shared.sum()) - start)), dtype=np.float32)
        holds[own[low:high], col[low:high] - start] = 1
        both = both + holds[q] @ holds[t].T
    if isinstance(both, int):
        return t[:0], t[:0]
    union = size[q][:, None] + size[t] - both
    x, y = np.nonzero(both >= 1)
    link = both[x, y].astype(float) / union[x, y] >= SIMILARITY
    a, b = q[x], t[y]
    united(parent, a[link], b[link])
    return spanning(parent)


def confirmed(groups: DataFrame, sets: DataFrame, part: int) -> DataFrame:
    """(u, v): pairs of nodes at least SIMILARITY alike that together connect all such pairs of one root. groups: node, root; sets: node, found."""
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    dealt = grouped(groups.join(sets, "node"), ["root"], "node", part).select("root", "i", "j", "node", "found", "tree", "ask")

    def run(batches):
        rows, at = [], None
        for rb in batches:
            for root, i, j, name, found, tree, ask in zip(*(c.to_pylist() if n != "found" else c for n, c in zip(rb.schema.names, rb.columns, strict=True)), strict=True):
                if at != (root, i, j) and rows:
                    yield from pairs(rows)
                    rows = []
                at = root, i, j
                rows.append((name, np.frombuffer(found.as_py(), dtype=np.uint64), tree, ask))
        if rows:
            yield from pairs(rows)

    def pairs(rows):
        name, found, tree, ask = zip(*rows, strict=True)
        u, v = alike(found, np.array(tree), np.array(ask))
        name = np.array(name)
        yield batch(out, pa.array(name[u]), pa.array(name[v]))

    return dealt.mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, words: int = 5, radius: int = RADIUS, part: int = PART, named: int = NAMED) -> DataFrame:
    """(doc_id, component_id), one row for each row of docs."""
    prints = stored(signatures(docs, words), "signatures")
    nodes = stored(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp")), "nodes")
    members = stored(shards(nodes.select("node", "fp"), nodes.count(), radius), "shards")
    groups = components(candidates(members, radius, part))
    groups = stored(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()), "groups")
    sets = stored(whole_sets(docs, nodes.join(small_or_shuffled(groups), "node", "left_semi"), words), "sets")
    labels = components(confirmed(groups, sets, named))
    labelled = nodes.select("node", "least").join(small_or_shuffled(labels), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stored(labelled.select("node", "root").join(ids, "root").select("node", "component_id"), "components")
    return prints.select("doc_id", "node").join(of, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document of each component: the one that names it."""
    return one_of_each(docs, near_copies(docs))
