"""Personal data by fixed patterns plus a semi-Markov conditional random field.

Four kinds: email, ip, card, phone. Base spans follow exact patterns and are never lost. The random field looks at what
the patterns leave: it cuts the text around digits, "@" and spelled-out addresses into atoms, scores whole candidate
segments (digit groups, separators, checksum, neighbours, cue words) and finds by dynamic programming over segments of
bounded length the best joint choice of boundaries and kinds. Text without a candidate adds nothing to any path, so
leaving it out is exact. The weights are fitted here, by likelihood, on sentences generated with a fixed seed.

Null and empty texts have no spans. Spans are in code points, ends exclusive; spans of different kinds may overlap
among base spans only. Texts of any length are read whole; patterns and segments take linear time. Repeated rows repeat
their results; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batch, documents, ids_and_texts, slices

KINDS = ("email", "ip", "card", "phone")
#: Longest segment in atoms, atoms of context around a candidate, and weights' penalty.
LONGEST, AROUND, PENALTY = 18, 8, 0.02
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The same matches as [0-9]+ and three dotted parts: a run that fails from its first digit fails from all.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_SEED = re.compile(r"\+?\(?[0-9](?:[\x20().\-/]{0,3}[0-9]){6,}|@|\[\.\]|(?i:[\[(]at[\])]|(?<![a-z])dot(?![a-z]))")
_CUES = {"mail": "email", "email": "email", "contact": "email", "write": "email", "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "card": "card", "visa": "card", "pay": "card", "tel": "phone", "phone": "phone", "call": "phone", "fax": "phone", "mobile": "phone"}
_LAST = frozenset("com org net edu gov io de fr es uk info".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        v = (ord(x) - 48) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    codes = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if ((codes - 48) < 10).any():
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


class Candidates:
    """Atoms of one stretch of text, and the segments among them that could be personal data, with their features."""

    def __init__(self, text: str, low: int, high: int, taken: list[tuple[int, int]]):
        self.atoms = [(m.start(), m.end(), m[0]) for m in _ATOM.finditer(text, low, high)]
        self.segments: list[tuple[int, int, tuple[int, ...], tuple[str, ...]]] = []  # first atom, end, kinds, features
        atoms = self.atoms
        spans = Reach(taken)
        blocked = [spans.end_before(b) > a for a, b, _ in atoms]
        for i, (a, _, first) in enumerate(atoms):
            if blocked[i] or not (first[0].isascii() and first[0].isalnum() or first in "+("):
                continue
            digits, at, dots = 0, 0, 0
            for j in range(i, min(len(atoms), i + LONGEST)):
                start, end, s = atoms[j]
                if blocked[j] or j > i and (gap := text[atoms[j - 1][1] : start]) and gap != " ":
                    break
                digits += len(s) if "0" <= s[0] <= "9" else 0
                at += s == "@" or s.lower() == "at"
                dots += at > 0 and (s == "." or s.lower() == "dot")
                if at > 1:
                    break
                if not (s[0].isascii() and s[0].isalnum()) or text[end : end + 1].isalnum() or text[atoms[i][0] - 1 : atoms[i][0]].isalnum():
                    continue
                if at and dots:
                    self.segments.append((i, j + 1, (0,), self.features(text, i, j + 1)))
                elif not at and 7 <= digits <= 24:
                    self.segments.append((i, j + 1, (1, 2, 3), self.features(text, i, j + 1)))

    def features(self, text: str, i: int, j: int) -> tuple[str, ...]:
        atoms = self.atoms
        own = [s for _, _, s in atoms[i:j]]
        a, b = atoms[i][0], atoms[j - 1][1]
        s = text[a:b]
        groups = [len(x) for x in own if "0" <= x[0] <= "9"]
        letters = [x.lower() for x in own if x.isalpha() and x.isascii()]
        marks = {x for x in own if not x.isalnum()}
        digits = "".join(x for x in own if "0" <= x[0] <= "9")
        n = len(digits)
        before, after = text[a - 1 : a], text[b : b + 1]
        out = ["bias", f"n{n if n < 20 else 20}", f"groups{min(len(groups), 7)}", f"letters{min(len(letters), 6)}", f"spaces{min(s.count(' '), 5)}"]
        out += [f"mark{m}" for m in sorted(marks)]
        if own[0] == "+":
            out.append("plus")
        if not letters:
            out.append("shape:" + re.sub("[0-9]", "9", s))
            out.append(f"n{n}-groups{len(groups)}-{''.join(sorted(marks))}")
        if 12 <= n <= 19 and not letters:
            out.append("long-digits" + "-luhn" * luhn(digits))
        if len(set(groups)) == 1 and len(groups) > 1:
            out.append(f"even{groups[0]}")
        if groups[-3:] == [3, 3, 4] and len(groups) <= 4:
            out.append("three-three-four")
        if len(groups) == 4 and marks == {"."} and not letters:
            out.append("quad" + "-small" * all(int(x) < 256 for x in own[::2]))
        if letters:
            spelled = [x for x in letters if x in ("at", "dot")]
            out.append(f"spelled{min(len(spelled), 4)}")
            out.append("tld" if own[-1].lower() in _LAST else "no-tld")
            if "@" in marks or "at" in letters:
                cut = own.index("@") if "@" in own else [x.lower() for x in own].index("at")
                tail = [x for x in own[cut + 1 :] if x not in ("]", ")", "[", "(")]
                out.append(f"tail{min(len(tail), 6)}")
                out.append("host" if len(tail) >= 3 and (tail[1] == "." or tail[1].lower() == "dot") else "no-host")
                head = [x for x in own[:cut] if x not in ("]", ")", "[", "(")]
                out.append(f"head{min(len(head), 4)}" + "-spaced" * (" " in text[a : atoms[i + cut][0]].rstrip(" [(")))
        if before.isalnum() or before and before in "+@._%-#/":
            out.append("cut-left")
        if after.isalnum() or after == "@" or after in (".", "-", "_", "/", ",") and text[b + 1 : b + 2].isalnum():
            out.append("cut-right")
        for k in range(max(0, i - 3), i):
            if (cue := _CUES.get(atoms[k][2].lower())) is not None:
                out.append(f"cue-{cue}")
        return tuple(out)


def _sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


class SpanField:
    """Weights of (feature, kind), by kind; outside atoms score 0."""

    def __init__(self):
        self.weights: list[dict[str, float]] = [{} for _ in KINDS]

    def score(self, features: tuple[str, ...], kind: int) -> float:
        w = self.weights[kind]
        return sum(w.get(f, 0.0) for f in features)

    def best(self, c: Candidates) -> list[tuple[int, int, int]]:
        """(start, kind, end) in the text, of the best path."""
        ending: dict[int, list] = {}
        for i, j, kinds, f in c.segments:
            for k in kinds:
                if (v := self.score(f, k)) > 0:
                    ending.setdefault(j, []).append((v, i, k))
        top, back = [0.0] * (len(c.atoms) + 1), [None] * (len(c.atoms) + 1)
        for j in range(1, len(top)):
            top[j] = top[j - 1]
            for v, i, k in ending.get(j, ()):
                if top[i] + v > top[j]:
                    top[j], back[j] = top[i] + v, (i, k)
        out, j = [], len(c.atoms)
        while j:
            if back[j]:
                i, k = back[j]
                out.append((c.atoms[i][0], k, c.atoms[j - 1][1]))
                j = i
            else:
                j -= 1
        return out[::-1]

    def fit(self, examples: list[tuple[Candidates, set]], rounds: int = 10, rate: float = 0.3, seed: int = 7) -> None:
        """Maximise the likelihood of the gold segments {(i, j, kind)} by stochastic gradient steps."""
        rng = random.Random(seed)
        for step in range(rounds):
            rng.shuffle(examples)
            eta = rate / (1 + step)
            for c, gold in examples:
                n = len(c.atoms)
                arcs = [(i, j, k, f, self.score(f, k)) for i, j, kinds, f in c.segments for k in kinds]
                into, out_of = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
                for arc in arcs:
                    into[arc[1]].append(arc)
                    out_of[arc[0]].append(arc)
                ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
                for j in range(1, n + 1):
                    ahead[j] = _sum([ahead[j - 1], *(ahead[i] + v for i, _, _, _, v in into[j])])
                for i in range(n - 1, -1, -1):
                    behind[i] = _sum([behind[i + 1], *(v + behind[j] for _, j, _, _, v in out_of[i])])
                for i, j, k, f, v in arcs:
                    change = ((i, j, k) in gold) - math.exp(ahead[i] + v + behind[j] - ahead[n])
                    if abs(change) > 1e-4:
                        w = self.weights[k]
                        for x in f:
                            w[x] = w.get(x, 0.0) * (1 - eta * PENALTY) + eta * change


def generated(seed: int, count: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with known spans: forms that the fixed patterns miss, and numbers that are no personal data."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def email():
        dot, at = rng.choice([(" dot ", " at "), (" [dot] ", " [at] "), ("[dot]", "[at]"), (" (dot) ", " (at) "), (" dot ", "@"), (".", " [at] "), (".", "(at)")])
        host = dot.join([word(), *([word()] if rng.random() < 0.3 else []), rng.choice(sorted(_LAST))])
        return rng.choice([word(), word() + num(2), f"{word()}.{word()}"]) + at + host

    def phone():
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"0{num(2)} {num(3)} {num(4)}", f"00{num(2)} {num(3)} {num(6)}"])

    def card():
        return rng.choice([".", "/"]).join(num(4) for _ in range(4))

    def ip():
        return rng.choice([" . ", "[.]"]).join(str(rng.randint(0, 255)) for _ in range(4))

    makers = (email, ip, card, phone)
    noise = [lambda: num(rng.randint(20, 30)), lambda: f"{num(4)}-{num(2)}-{num(2)} {num(2)}:{num(2)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), lambda: f"{num(3)},{num(3)},{num(3)}", lambda: f"v{num(1)}.{num(2)}.{num(4)}", lambda: f"{num(8)}", lambda: f"{num(10)}", lambda: f"{num(16)}", lambda: f"no. {num(7)}", lambda: f"at {word()} dot", lambda: f"{num(4)} {num(4)} {num(4)}", lambda: f"{num(2)} {num(2)} {num(2)} {num(2)}", lambda: f"{num(3)}.{num(3)}.{num(3)}.{num(3)}.{num(3)}", lambda: f"{word()}@{word()}", lambda: f"3.{num(12)}"]
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 5))) + " "
            if rng.random() < 0.55:
                k = rng.choice((0, 0, 1, 2, 3, 3))
                if rng.random() < 0.3:
                    text += rng.choice([c for c, of in sorted(_CUES.items()) if of == KINDS[k]]) + rng.choice([": ", " "])
                s = makers[k]()
                spans.append((len(text), k, len(text) + len(s)))
            else:
                s = rng.choice(noise)()
            text += s + rng.choice([" ", ". ", ", ", "\n", "!! "])
        out.append((text + word(), spans))
    return out


class Reach:
    """Spans by start, with the largest end up to each: overlaps without a pass over all spans."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts, self.ends = [s for s, _ in self.spans], list(accumulate((e for _, e in self.spans), max))

    def end_before(self, at: int) -> int:
        """The largest end of spans that start before at; -1 without any."""
        i = bisect_left(self.starts, at)
        return self.ends[i - 1] if i else -1

    def between(self, low: int, high: int) -> list[tuple[int, int]]:
        """Spans that overlap low to high."""
        i = j = bisect_left(self.starts, high)
        while i and self.ends[i - 1] > low:
            i -= 1
        return [x for x in self.spans[i:j] if x[1] > low]


def _stretches(text: str, taken: list[tuple[int, int]]):
    """Parts of the text around what could be personal data beyond the spans taken, apart from each other."""
    low = high = -1
    spans = Reach(taken)
    for m in _SEED.finditer(text):
        if spans.end_before(m.start() + 1) >= m.end():
            continue
        a, b = max(0, m.start() - 12 * AROUND), min(len(text), m.end() + 12 * AROUND)
        a = text.rfind("\n", 0, m.start()) + 1 if "\n" in text[a : m.start()] else a
        if low >= 0 and a <= high:
            high = max(high, b)
        else:
            if low >= 0:
                yield low, high
            low, high = a, b
    if low >= 0:
        yield low, high


@cache
def trained(seed: int = 20, count: int = 600) -> SpanField:
    """The fitted field: `count` generated sentences."""
    examples = []
    for text, spans in generated(seed, count):
        c = Candidates(text, 0, len(text), [])
        at = {(c.atoms[i][0], c.atoms[j - 1][1]): (i, j) for i, j, _, _ in c.segments}
        gold = {(*at[s, e], k) for s, k, e in spans if (s, e) in at}
        if c.segments:
            examples.append((c, gold))
    field = SpanField()
    field.fit(examples)
    return field


def added_spans(text: str, base: list[tuple[int, int, int]], field: SpanField) -> list[tuple[int, int, int]]:
    """Spans of the best path beside the base spans."""
    if not _SEED.search(text):
        return []
    taken = [(s, e) for s, _, e in base]
    out, spans = [], Reach(taken)
    for low, high in _stretches(text, taken):
        c = Candidates(text, low, high, spans.between(low, high))
        if c.segments:
            out += field.best(c)
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def find_pii(docs: DataFrame, seed: int = 20) -> DataFrame:
    """doc_id, base and spans (strings kind:start:end, comma-joined) and redacted (each span replaced by its kind)."""
    field = docs.sparkSession.sparkContext.broadcast(trained(seed).weights)  # some hundred weights, whatever the input
    out = pa.schema([("doc_id", pa.int64()), ("base", pa.string()), ("spans", pa.string()), ("redacted", pa.string())])

    def run(batches):
        model = SpanField()
        model.weights = field.value
        for rb in batches:
            for part in slices(rb):
                base, spans, redacted = [], [], []
                for t in part.column(1).to_pylist():
                    own = base_spans(t)
                    every = sorted(own + added_spans(t, own, model))
                    base.append(_joined(own))
                    spans.append(_joined(every))
                    redacted.append(redact(t, every))
                yield batch(out, part.column(0), base, spans, redacted)

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, base string, spans string, redacted string")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or union of overlapping spans, replaced by the kind of its first: [EMAIL]."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def redacted_texts(docs: DataFrame, seed: int = 20) -> DataFrame:
    """docs, all columns, text without personal data and n_chars as it is then; null texts stay null."""
    field = docs.sparkSession.sparkContext.broadcast(trained(seed).weights)

    @F.pandas_udf("string")
    def clean(texts):
        model = SpanField()
        model.weights = field.value
        return texts.map(lambda t: t if t is None else redact(t, sorted((own := base_spans(t)) + added_spans(t, own, model))))

    text = clean(docs["text"].cast("string"))
    cols = [text.alias(c) if c == "text" else docs[c] for c in docs.columns]
    out = docs.select(*cols)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter(F.split("base", ","), lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
