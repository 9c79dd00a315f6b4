"""SentencePiece (merge type) encoding and decoding with a table of last tokens.

In a merge encoding each prefix of a text has exactly one possible last token. An automaton reports every piece that
ends at a position; the piece is the last token there exactly if it is compatible with the last token of the prefix
before it, that is, if merging by rank would leave the two side by side. Walking the table backwards gives the ids.
The time is linear in the matches, with no heap and no repeated merging.

Where no piece goes on from a character into white space, the text falls apart into words that are encoded on their
own; a bounded table keeps the ids of words already seen in a task. Null text counts as empty; an empty text has the
end id alone. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .shared import batch, documents, ids_and_texts, slices

SPACE = "▁"
#: Words and pairs that a task remembers before it starts afresh.
REMEMBERED = 400_000


class PieceCodec:
    """Encode and decode with the model at path, equal to the sentencepiece library with an end id only."""

    def __init__(self, path: str):
        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.end, self.unknown = sp.eos_id(), sp.unk_id()
        self.byte_ids = [0] * 256
        plain = []
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append(i)
        self.fallback = any(self.byte_ids)
        name = {i: sp.id_to_piece(i) for i in plain}
        # Tokens are numbered by rank: 0 stands for any unknown character, then characters, then merges, best first.
        order = sorted(plain, key=lambda i: (len(name[i]) > 1, -sp.get_score(i)))
        self.piece, self.id_of = [""], [self.unknown]
        self.left, self.right, self.pairs, number = [0], [0], {}, {}
        self._fits: dict[int, bool] = {}
        for i in order:
            s, k = name[i], len(self.piece)
            if len(s) > 1:
                cut = next((c for c in range(1, len(s)) if (a := number.get(s[:c])) and (b := number.get(s[c:])) and self.fits(a, b)), 0)
                if not cut:
                    if sp.encode(s, add_bos=False, add_eos=False) == [i]:
                        raise ValueError(f"piece {s!r} can't be made from better-ranked pieces")
                    continue
                a, b = number[s[:cut]], number[s[cut:]]
                self.pairs[a << 20 | b] = k
            else:
                a = b = k
            self.left.append(a)
            self.right.append(b)
            self.piece.append(s)
            self.id_of.append(i)
            number[s] = k
        self.chars = {s for s in self.piece if len(s) == 1}
        self.automaton = ahocorasick.Automaton()
        for s, k in number.items():
            self.automaton.add_word(s, (len(s), k))
        self.automaton.make_automaton()
        joined = [s for s in self.piece if len(s) > 1]
        apart = all(SPACE not in s.lstrip(SPACE) for s in joined)
        lines = all("\n" not in s for s in joined)
        self.words = re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if apart and lines else rf"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else r"(?s:.+)").findall
        self.known: dict[str, bytes] = {}
        self.raw = [b"\xff" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.is_byte = [sp.is_byte(i) for i in range(n)]
        self.is_control = [sp.is_control(i) for i in range(n)]
        if sp.normalize(" a  béﬁ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}béﬁ":
            raise ValueError("only models without text normalisation are supported")

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a and b can stand side by side: undoing merges from the last, no pair across may merge sooner."""
        key = a << 20 | b
        if (known := self._fits.get(key)) is not None:
            return known
        pairs, left, right, before, fit = self.pairs, self.left, self.right, 1 << 30, True
        while True:
            if pairs.get(a << 20 | b, before) < before:
                fit = False
                break
            if a > b:  # a was merged later: look at its right part
                before, a = a, right[a]
                if a == before:
                    if left[b] == b:
                        break
                    before, b = b + 1, left[b]
            else:
                before, part = b + 1, left[b]
                if part == b:
                    before = a
                    if right[a] == a:
                        break
                    a = right[a]
                else:
                    b = part
        if len(self._fits) >= 4 * REMEMBERED:
            self._fits.clear()
        self._fits[key] = fit
        return fit

    def _word(self, s: str) -> bytes:
        """The ids of one word, as 32-bit integers."""
        n = len(s)
        last = [0] * (n + 1)
        done, fits, known = 0, self.fits, self._fits
        for end, (size, k) in self.automaton.iter(s):
            end += 1
            if last[end] or last[end - size] == 0 and end > size and s[end - size - 1] in self.chars:
                continue
            if end == size or (known.get(last[end - size] << 20 | k)) or fits(last[end - size], k):
                last[end] = k
                done += 1
        out, end, ids, piece = [], n, self.id_of, self.piece
        while end:
            if k := last[end]:
                out.append(ids[k])
                end -= len(piece[k])
            else:
                end -= 1
                out += [self.byte_ids[x] for x in reversed(s[end].encode())] if self.fallback else [self.unknown]
        return array("i", reversed(out)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text, the end id included."""
        if not text:
            return np.array([self.end], dtype=np.int32)
        words = self.words(SPACE + text.replace(" ", SPACE))
        known = self.known
        try:
            parts = [known[w] for w in words]
        except KeyError:
            parts = []
            for w in words:
                if (ids := known.get(w)) is None:
                    ids = self._word(w)
                    if len(w) <= 64:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[w] = ids
                parts.append(ids)
        parts.append(array("i", [self.end]).tobytes())
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        raw, n = self.raw, len(ids)
        while n and ids[n - 1] == self.end:
            n -= 1
        out = b"".join([raw[i] for i in ids[:n]])
        if n and not self.is_byte[ids[0]] and ids[0] != self.unknown and raw[ids[0]][:1] == b" ":
            out = out[1:]
        try:
            return out.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids)

    def _decode_broken(self, ids: list[int]) -> str:
        """With byte runs that are no UTF-8, each wrong byte of which becomes U+FFFD, or with control ids inside."""
        out, run, started = [], b"", False
        for i in [*ids, self.end]:
            if self.is_byte[i]:
                run += self.raw[i]
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append("�")
                run, started = run[size:], True
            s = "" if self.is_control[i] else self.raw[i].decode()
            if s and not started and i != self.unknown:
                s, started = s.removeprefix(" "), True
            elif s:
                started = True
            out.append(s)
        return "".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec a process and model."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array of int, the end id included), one row for each row of docs."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        c = codec(model_path)
        for rb in batches:
            for part in slices(rb):
                yield batch(out, part.column(0), pa.array([c.encode(t) for t in part.column(1).to_pylist()], type=pa.list_(pa.int32())))

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give an empty text."""
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        c = codec(model_path)
        for rb in batches:
            yield batch(out, rb.column(0), [c.decode(ids or []) for ids in rb.column(1).to_pylist()])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<int>) ids").mapInArrow(run, "doc_id long, text string")


def encoding_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode and decode each document in one pass and return the digests of both."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        c = codec(model_path)
        decimal = [str(i) for i in range(len(c.raw))]
        for rb in batches:
            for part in slices(rb):
                n, a, b = [], [], []
                for t in part.column(1).to_pylist():
                    ids = c.encode(t).tolist()
                    n.append(len(ids))
                    a.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                    b.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                yield batch(out, part.column(0), n, a, b)

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return encoding_digests(documents(spark, sf_dir), model_path)
