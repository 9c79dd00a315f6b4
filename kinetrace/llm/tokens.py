"""Token ids of whole texts by the tokenizers library, with ids of pieces already seen kept in bounded tables.

Texts of Latin-1 characters are normalised and split here, as both vocabularies do it (there composition changes nothing
and lower case needs no context), and the library's merge model gives the ids of each new piece. In other texts no
piece runs on from a visible character into a space or newline, so they are cut there and new parts go through the whole
library; those with other white space, where the split looks further, go to it uncut. So do texts that hold the string of
an added token, which the library takes as that token.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from tokenizers import Tokenizer

#: Parts, and pieces of parts, that a task remembers before it starts afresh.
REMEMBERED = 300_000
_PARTS = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
#: White space beyond Latin-1's space and newline; characters that some library counts as such are included.
_OTHER_WHITE = [chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t\n\x0b\x0c\r \x85\xa0"
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
_SPLIT = {
    "byte": re.compile(rf" ?[{_L}]+|{_ENDINGS}| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall,
    "word": re.compile(rf"[{_L}]+|{_ENDINGS}|[{_N}]|[^{_S}{_L}{_N}]+").findall,
}

#: In RE2: what "word" splits besides runs of letters.
_NO_WORD = rf"({_ENDINGS}|[{_N}]|[^\t\n\x0b\x0c\r {_L}{_N}]+)"


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Table(dict):
    """Ids by key; what is missing is made, and remembered if short. What was not asked for since the table was last half full goes first."""

    def __init__(self, make):
        self.make, self.before = make, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.before.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= 64:
            if len(self) >= REMEMBERED // 2:
                self.before = self.copy()
                self.clear()
            self[key] = ids
        return ids


class Ids:
    """Ids of texts, with an end id after each. kind: "byte" (byte-level, keeps white space) or "word" (drops it)."""

    def __init__(self, path: str, kind: str, end: int = 1):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.kind, self.letters = self.tokenizer.model, kind, _byte_letters()
        self.plain = re.compile("[!-~]+").fullmatch
        self.split, self.parts, self.pieces = _SPLIT[kind], _Table(self._whole), _Table(self._piece)
        self.tail = np.array([end], dtype="<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        letters = piece if self.plain(piece) else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of lower-case Latin-1 texts whose only white space is ASCII's: each distinct piece is looked up once."""
        cut = pa.compute.ascii_split_whitespace(pa.compute.replace_substring_regex(pa.array(texts, pa.large_string()), _NO_WORD, r" \1 "))
        named = cut.values.dictionary_encode()
        found = list(map(self.pieces.__getitem__, named.dictionary.to_numpy(zero_copy_only=False).tolist()))
        ids = np.frombuffer(b"".join([*found, self.tail]), dtype="<u4")
        size = np.array([*map(len, found), 4], dtype=np.int32) >> 2
        first = np.cumsum(size, dtype=np.int32) - size
        ends = np.asarray(cut.offsets)[1:]
        piece = np.insert(named.indices.to_numpy(zero_copy_only=False), ends, len(found))  # the end id as a last piece
        each = size[piece]
        stop = np.cumsum(each, dtype=np.int64)
        out = ids[np.repeat(first[piece] - (stop - each), each) + np.arange(stop[-1])]
        return np.split(out, stop[ends + np.arange(len(ends))][:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids for each text."""
        out, plain = [], []
        for t in texts:
            if any(a in t for a in self.added):
                out.append(np.frombuffer(self._whole(t) + self.tail, dtype="<u4"))
                continue
            try:
                t.encode("latin-1")
                if self.kind == "byte":
                    ids = b"".join(map(self.pieces.__getitem__, self.split(t)))
                elif "\x85" in t or "\xa0" in t:
                    ids = b"".join(map(self.pieces.__getitem__, self.split(t.lower())))
                else:
                    plain.append((len(out), t.lower()))
                    out.append(None)
                    continue
            except UnicodeEncodeError:
                if any(c in t for c in _OTHER_WHITE):
                    ids = self._whole(t)
                else:
                    ids = b"".join(map(self.parts.__getitem__, t.replace("\n", " ").split(" ") if self.kind == "word" else _PARTS(t)))
            out.append(np.frombuffer(ids + self.tail, dtype="<u4"))
        if plain:
            for (i, _), ids in zip(plain, self._plain([t for _, t in plain]), strict=True):
                out[i] = ids
        return out


_open: dict[tuple, Ids] = {}


def ids_of(path: str, kind: str, end: int = 1) -> Ids:
    """One tokenizer a process and vocabulary."""
    key = (path, kind, end)
    if key not in _open:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _open[key] = Ids(*key)
    return _open[key]
