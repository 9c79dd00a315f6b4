"""Substring dedup by hashes of lines.

A text is cut into lines and, within lines, after sentence ends. Each line, and from each cut the shortest run of
sentences with at least `words` words (it may go on over line ends), is a unit. It is normalised (lower case, single spaces) and digested with 128 bits. Digests are grouped over the whole
table; the occurrence of smallest rank (doc_id, then offset) stays and the units of all others are removed, so a passage
that other texts also hold is found wherever it starts within a line, without comparing documents. Offsets of what is
removed are those of the original text, in code points, ends exclusive.

A digest's group is never gathered: it is counted with partial aggregation and joined back by a join that Spark splits
if a digest is very common. Null texts count as empty; texts without words have no units; a null
doc_id ranks after all others. Rows that repeat doc_id and text count as one document (both keep the same units); rows
that share a doc_id with other texts, or have none, rank by a hash of the text. Very long texts are cut whole; extra
columns are left aside. Repeats inside one text are removed too. An empty
table gives no rows.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batch, documents, ids_and_texts, slices

#: A run this long fits, from its first cut, into passages of over 50 words, and ordinary sentences rarely repeat by chance in it.
WORDS = 20
LAST = (1 << 63) - 1
_CUT = re.compile(r"(?<=[.!?])[ \t]+|[ \t]*\n\s*")


def units(text: str, words: int = WORDS):
    """(digest, start, end) of each line, and of the run of sentences with at least `words` words that begins at each cut."""

    def digest(run):
        return blake2b(" ".join(run).encode("utf-8", "surrogatepass"), digest_size=16).digest()

    cuts, lines, at, n = [], [], 0, len(text)
    for m in [*_CUT.finditer(text), None]:
        end, after = m.span() if m else (n, n)
        if end > at:
            cuts.append((at, end, text[at:end].lower().split()))
        if m is None or "\n" in m[0]:
            lines.append(len(cuts))
        at = after
    first = 0
    for last in lines:
        line = [w for c in cuts[first:last] for w in c[2]]
        if line:
            yield digest(line), cuts[first][0], cuts[last - 1][1]
        first = last
    lines, j, held = {(a, b) for a, b in zip([0, *lines], lines)}, 0, 0
    for i in range(len(cuts)):
        while j < len(cuts) and held < words:
            held += len(cuts[j][2])
            j += 1
        if held < words:
            break
        if (i, j) not in lines:
            yield digest([w for c in cuts[i:j] for w in c[2]]), cuts[i][0], cuts[j - 1][1]
        held -= len(cuts[i][2])


def _hashed(docs: DataFrame) -> DataFrame:
    plain = ids_and_texts(docs)
    return plain.select("doc_id", "text", F.xxhash64("text").alias("of"))


def unit_table(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(a, b, rank, of, start, end, again): digests of all units; again marks repeats inside a text."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("rank", pa.int64()), ("of", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("again", pa.bool_())])

    def run(batches):
        for rb in batches:
            for part in slices(rb, 2 << 20):
                digests, spans, rows, again = [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    seen = set()
                    for d, s, e in units(t, words):
                        again.append(d in seen)
                        seen.add(d)
                        digests.append(d)
                        spans.append((s, e))
                        rows.append(i)
                if rows:
                    h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                    rows, spans = np.array(rows), np.array(spans)
                    rank = part.column(0).fill_null(LAST).to_numpy()[rows]
                    for i in range(0, len(rows), 1 << 15):
                        k = slice(i, i + (1 << 15))
                        yield batch(out, *(pa.array(np.ascontiguousarray(c[k])) for c in (h[:, 0], h[:, 1], rank, part.column(2).to_numpy()[rows], spans[:, 0], spans[:, 1])), pa.array(again[k], pa.bool_()))

    return _hashed(docs).mapInArrow(run, "a long, b long, rank long, of long, start long, end long, again boolean")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans, and the spans with the white space after them, merged."""
    wide = []
    for s, e in merged(spans):
        m = _CUT.match(text, e)
        wide.append((s, m.end() if m else e))
    wide, out, at = merged(wide), [], 0
    for s, e in wide:
        out.append(text[at:s])
        at = e
    return "".join([*out, text[at:]]), wide


def line_dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_removed, removed (start:end, comma-joined, of the original text), text (what is kept)."""
    every = unit_table(docs, words)
    first = every.where("not again").groupBy("a", "b").agg(F.min(F.struct("rank", "of")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = every.where("not again").join(first.select("a", "b", "first"), ["a", "b"]).where("struct(rank, of) > first")
    spans = later.select("rank", "of", "start", "end").unionByName(every.where("again").select("rank", "of", "start", "end"))
    gone = spans.groupBy("rank", "of").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # bounded by the text
    texts = _hashed(docs).withColumn("rank", F.coalesce("doc_id", F.lit(LAST)))
    out = pa.schema([("doc_id", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.string()), ("text", pa.string())])

    def run(batches):
        for rb in batches:
            for part in slices(rb):
                n, removed, kept = [], [], []
                for t, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    t, wide = without(t, [(s["start"], s["end"]) for s in found or ()])
                    n.append(len(wide))
                    removed.append(",".join(f"{s}:{e}" for s, e in wide))
                    kept.append(t)
                yield batch(out, part.column(0), n, removed, kept)

    return texts.join(gone, ["rank", "of"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_removed long, removed string, text string")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))
