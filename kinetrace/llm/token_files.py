"""Token-id files in Simple-8b words, in ascending doc_id order.

A 64-bit word holds a 4-bit selector and as many ids as fit its 60 bits; selector 0 is the escape, after which one word
holds a value of over 60 bits. Words never cross documents, so each document is a block with its own word offset, and a
segment decodes whole with a few array operations for each selector.

Segment image (little-endian): b"S8B1", uint32 number of documents n, uint64 number of words m; then arrays int64
doc_id[n], uint8 has_id[n], int64 n_ids[n], uint64 word_offset[n + 1], uint64 words[m]. Segments are at most about
`SEGMENT` bytes (more only for a single larger document). Spark's writers commit them as binary columns, so they reach
any store that Spark reaches and lost tasks leave nothing; export_segments() gives the images for plain files.

Documents are dealt to partitions by quantiles of doc_id and sorted there, so rising partition and segment numbers
mean rising ids; rows with a null doc_id come first. Null and empty texts have the end id alone; repeated rows are kept
and adjoin; texts of any length are encoded whole; an empty table gives no segments.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batch, documents, fresh_path, ids_and_texts, slices
from .tokens import ids_of

#: Selector s packs COUNTS[s] values of BITS[s] bits; 0 is the escape.
BITS = (64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
SEGMENT = 4 << 20
#: Words that a reader decodes at once, and bytes of text that a writer encodes at once.
RUN, TEXT = 1 << 16, 4 << 20
_LIMITS = np.array([1 << b for b in BITS[1:]], dtype=np.uint64)
#: The smallest selector for each value of 16 bits.
_NEEDS = (np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right") + 1).astype(np.int8)


def encode(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the blocks (consecutive runs of `lengths` values) and the number of words of each block."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(lengths), np.int64)
    # Smallest selector; 15 asks for the escape.
    needs = _NEEDS[values] if values.max() < 1 << 16 else np.searchsorted(_LIMITS, values, side="right").astype(np.int8) + 1
    ends = np.cumsum(lengths)
    end = np.repeat(ends, lengths)
    # The most that windows of each count need, with room after each block for windows that reach beyond it.
    room = np.arange(n) + np.repeat(np.arange(len(lengths)) * COUNTS[1], lengths)
    widest = np.zeros(n + len(lengths) * COUNTS[1], dtype=np.int8)
    widest[room] = needs
    best, count = np.where(widest > 14, 0, 14).astype(np.int8), 1
    for s in range(13, 0, -1):
        more = COUNTS[s] - count
        widest[:-more] = np.maximum(widest[:-more], widest[more:])
        count = COUNTS[s]
        np.copyto(best, np.int8(s), where=widest <= s)
    best = best[room]
    starts = word_starts(np.minimum(np.arange(n) + np.array(COUNTS)[best], end), ends - lengths, ends)
    sel = best[starts]
    sizes = np.diff(np.r_[starts, n])
    escaped = sel == 0
    place = np.arange(len(starts)) + np.r_[0, np.cumsum(escaped)[:-1]]
    words = np.zeros(len(starts) + int(escaped.sum()), dtype=np.uint64)
    words[place] = sel.astype(np.uint64) << np.uint64(60)
    words[place[escaped] + 1] = values[starts[escaped]]
    for s in range(1, 15):
        own = np.flatnonzero(sel == s)
        if not len(own):
            continue
        at, size, packed = starts[own], sizes[own], words[place[own]]
        for k in range(COUNTS[s]):
            v = values[np.minimum(at + k, n - 1)]
            v[size <= k] = 0
            packed |= v << np.uint64(BITS[s] * k)
        words[place[own]] = packed
    per_block = np.bincount(np.searchsorted(ends, starts, side="right"), weights=1 + escaped, minlength=len(lengths)).astype(np.int64)
    return words, per_block


def word_starts(after: np.ndarray, begins: np.ndarray, ends: np.ndarray, few: int = 48) -> np.ndarray:
    """Where words start, ascending: after[i] follows i. All blocks step at once, the last few long ones one by one."""
    found, at, stop = [], begins[begins < ends], ends[begins < ends]
    while len(at) > few:
        found.append(at)
        at = after[at]
        on = at < stop
        if not on.all():
            at, stop = at[on], stop[on]
    for i, end in zip(at.tolist(), stop.tolist(), strict=True):
        step, base, own = after[i:end].tolist(), i, []
        while i < end:
            own.append(i)
            i = step[i - base]
        found.append(np.array(own))
    return np.sort(np.concatenate(found))


def decode(words: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all blocks, and where each block starts among them; offsets are the blocks' first words."""
    words = np.asarray(words, dtype=np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int8)
    raw = np.zeros(len(words), dtype=bool)
    escapes = np.flatnonzero(sel == 0)
    if len(escapes):  # a word after an escape is data, even if its top bits look like an escape
        for i in escapes.tolist():
            if not raw[i] and i + 1 < len(words):
                raw[i + 1] = True
    counts = np.where(raw, 0, np.array(COUNTS, dtype=np.int64)[np.minimum(sel, 14)])
    slot = np.r_[0, np.cumsum(counts)]
    out = np.zeros(slot[-1], dtype=np.uint64)
    escapes = np.flatnonzero((sel == 0) & ~raw)
    out[slot[escapes]] = words[escapes + 1]
    for s in range(1, 15):
        own = np.flatnonzero((sel == s) & ~raw)
        if len(own):
            k = np.arange(COUNTS[s], dtype=np.uint64)
            out[slot[own][:, None] + k.astype(np.int64)] = (words[own][:, None] >> (k * np.uint64(BITS[s]))) & np.uint64((1 << BITS[s]) - 1)
    return out, slot[np.asarray(offsets, dtype=np.int64)[: len(lengths)]]


def segment(doc_ids: list, lengths: np.ndarray, per_block: np.ndarray, words: bytes) -> bytes:
    """The image of one segment."""
    n = len(doc_ids)
    ids = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    has = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    offsets = np.r_[0, np.cumsum(per_block)].astype("<u8")
    return b"".join([b"S8B1", struct.pack("<IQ", n, len(words) // 8), ids.tobytes(), has.tobytes(), np.asarray(lengths, dtype="<i8").tobytes(), offsets.tobytes(), words])


def read_segment(image: bytes) -> tuple[list, list[np.ndarray]]:
    """doc_ids and their arrays of ids (unsigned 64-bit)."""
    runs = list(read_runs(image))
    return [d for ids, _ in runs for d in ids], [a for _, arrays in runs for a in arrays]


def read_runs(image: bytes):
    """doc_ids and arrays as read_segment gives them, by runs of documents of about RUN words: only one run is decoded at a time."""
    image = memoryview(image)
    if image[:4] != b"S8B1":
        raise ValueError("no segment of token ids")
    n, m = struct.unpack_from("<IQ", image, 4)
    at, parts = 16, []
    for kind, size in (("<i8", n), ("u1", n), ("<i8", n), ("<u8", n + 1), ("<u8", m)):
        parts.append(np.frombuffer(image, dtype=kind, count=size, offset=at))
        at += parts[-1].nbytes
    ids, has, lengths, offsets, words = parts
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + np.uint64(RUN), side="right")) - 1)
        values, starts = decode(words[int(offsets[at]) : int(offsets[to])], offsets[at:to] - offsets[at], lengths[at:to])
        yield [i if h else None for i, h in zip(ids[at:to].tolist(), has[at:to].tolist(), strict=True)], [values[a : a + k] for a, k in zip(starts.tolist(), lengths[at:to].tolist(), strict=True)]
        at = to


def write_tokens(docs: DataFrame, tokenizer_path: str, out_path: str, kind: str = "word", end: int = 1) -> None:
    """Write the segments of docs to out_path: part, segment, first_token (within the part), n_tokens, image."""
    spark = docs.sparkSession
    docs = ids_and_texts(docs)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = np.unique(np.array(bounds, dtype=np.int64))
    coded = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("words", pa.binary())])
    made = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())])

    def encoded(batches):
        ids = ids_of(tokenizer_path, kind, end)
        for rb in batches:
            for part in slices(rb, TEXT):
                arrays = ids.encode(part.column(1).to_pylist())
                lengths = np.array([len(a) for a in arrays], dtype=np.int64)
                words, per_block = encode(np.concatenate(arrays), lengths)
                at = np.r_[0, np.cumsum(per_block)]
                keys = part.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
                dealt = np.searchsorted(bounds, keys, side="right").astype(np.int32)
                yield batch(coded, pa.array(dealt), part.column(0), pa.array(lengths), [words[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])

    def segments(batches):
        part, number, first, rows, size = None, 0, 0, [], 0

        def flush():
            nonlocal number, first, rows, size
            lengths, words = np.array([r[1] for r in rows]), b"".join(r[2] for r in rows)
            image = segment([r[0] for r in rows], lengths, np.array([len(r[2]) // 8 for r in rows]), words)
            made_row = batch(made, [part], [number], [first], [int(lengths.sum())], [image])
            number, first, rows, size = number + 1, first + int(lengths.sum()), [], 0
            return made_row

        for rb in batches:
            for p, doc_id, n, words in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if rows and (p != part or size + len(words) > SEGMENT):
                    yield flush()
                if p != part:
                    part, number, first = p, 0, 0
                rows.append((doc_id, n, words))
                size += len(words) + 33
        if rows:
            yield flush()

    rows = docs.mapInArrow(encoded, "part int, doc_id long, n long, words binary")
    ordered = rows.repartitionById(parts, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"))
    ordered.mapInArrow(segments, "part int, segment int, first_token long, n_tokens long, image binary").write.parquet(out_path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    files = spark.read.schema("part int, segment int, first_token long, n_tokens long, image binary").parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each partition
    total, base = 0, {}
    for r in sizes:
        base[r.part], total = total, total + r.n
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for rb in batches:
            for part, first, image in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), (x.as_buffer() for x in rb.column(2)), strict=True):
                start = base[part] + first
                for doc_ids, arrays in read_runs(image):
                    n = np.array([len(a) for a in arrays], dtype=np.int64)
                    starts = start + np.r_[0, np.cumsum(n)[:-1]]
                    start += int(n.sum())
                    for i in range(0, len(n), 1024):
                        yield batch(out, doc_ids[i : i + 1024], pa.array(starts[i : i + 1024]), pa.array(n[i : i + 1024]), [a.astype("<u4").tobytes() for a in arrays[i : i + 1024]])

    return files.select("part", "first_token", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def export_segments(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Copy segment images one by one to plain files in a folder of the driver; names sort in doc_id order."""
    import os

    os.makedirs(folder, exist_ok=True)
    names = []
    for r in spark.read.parquet(path).orderBy("part", "segment").toLocalIterator():
        names.append(f"{folder}/tokens-{r.part:05d}-{r.segment:05d}.s8b")
        with open(names[-1], "wb") as f:
            f.write(r.image)
    return names


def op9_token_files(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    path = fresh_path(spark, "token-ids")
    write_tokens(documents(spark, sf_dir), tokenizer_path, path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
