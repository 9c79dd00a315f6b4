"""Packing documents into token windows by the sum-of-squares rule.

Each document gives its whole windows away at once. What is left of it is placed online, as one piece, into the fill
level that minimises the sum over levels of the squared count of windows at that level (a new window counts as level
0); counts are kept in an array by level, ties go to the fullest window. A window that gets full is written and
forgotten. When a partition ends, the windows still open are poured together, cutting pieces at window ends, and the
very last tokens go to windows of power-of-two lengths, which need no padding.

Partitions pack on their own, in one pass and without a shuffle, holding open windows only. A null or empty text gives
its end id alone; repeated rows are packed as often as they come; texts of any length are packed whole; a null doc_id
stays null; an empty table gives no pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batch, documents, ids_and_texts, slices
from .tokens import ids_of

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Packer:
    """Places pieces (doc_id, start, ids, doc_tokens); rows() gives and forgets the rows of finished windows."""

    def __init__(self, size: int = 2048, first_id: int = 0):
        self.size, self.next_id = size, first_id
        self.count = np.zeros(size + 1)
        self.count[size] = -0.5  # so that 2 * count + 1 is 0: full windows don't count
        self.open: list[list[list]] = [[] for _ in range(size)]
        self.done: list[tuple] = []

    def level(self, n: int) -> int:
        """The fill level for a piece of n tokens, 0 for a new window."""
        c, room = self.count, self.size - n
        if room:
            change = c[1 + n : self.size + 1] - c[1 : room + 1]
            change[c[1 : room + 1] < 1] = np.inf
            best = room - int(np.argmin(change[::-1]))  # the fullest of the best
            if 2 * change[best - 1] + 2 <= 2 * c[n] + 1:
                return best
        return 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, start = len(ids), 0
        while n - start >= self.size:
            self._finish([(doc_id, start, ids[start : start + self.size], n)])
            start += self.size
        if start < n:
            self._place((doc_id, start, ids[start:].copy(), n))

    def _place(self, piece: tuple) -> None:
        n = len(piece[2])
        at = self.level(n)
        if at:
            window = self.open[at].pop()
            self.count[at] -= 1
        else:
            window = []
        window.append(piece)
        if at + n == self.size:
            self._finish(window)
        else:
            self.open[at + n].append(window)
            self.count[at + n] += 1

    def _finish(self, window: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, tokens in window:
            self.done.append((doc_id, start, len(ids), ids.astype("<u4", copy=False).tobytes(), tokens, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def close(self) -> None:
        """Pour the open windows together, so that only whole windows and lengths that are powers of two remain."""
        rest = [p for level in reversed(self.open) for window in level for p in window]
        left, window, room, want = sum(len(p[2]) for p in rest), [], 0, 0
        for doc_id, start, ids, tokens in rest:
            while len(ids):
                if not room:
                    want = room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                    left -= want
                part, ids = ids[:room], ids[room:]
                window.append((doc_id, start, part, tokens))
                start, room = start + len(part), room - len(part)
                if not room:
                    self._finish(window)
                    window = []
        self.open, self.count[: self.size] = [[] for _ in range(self.size)], 0

    def rows(self) -> pa.RecordBatch:
        done, self.done = self.done, []
        return batch(PIECES, *zip(*done, strict=True))


def pack(docs: DataFrame, path: str, size: int = 2048, kind: str = "byte", end: int = 1) -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary, little-endian 32-bit), doc_tokens, sequence_id, offset.

    size must be a power of two; sequence ids are unique over partitions.
    """

    def run(batches):
        encode = ids_of(path, kind, end).encode
        packer = Packer(size, TaskContext.get().partitionId() << 40)
        for rb in batches:
            for part in slices(rb, 4 << 20):
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    packer.add(doc_id, ids)
                    if len(packer.done) >= 2048:
                        yield packer.rows()
        packer.close()
        if packer.done:
            yield packer.rows()

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(docs, path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(documents(spark, sf_dir))
