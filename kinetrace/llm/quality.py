"""Quality classifier by co-training two views.

The text view sees the words of the whole text and its shape (capitals, marks, digits, repetition); the metadata view
sees source, language and length. Both are logistic regressions, first fitted on labelled rows. In each round either view
labels every unlabelled document of the table that it is sure of, and these documents go to the training rows of the
other view: the executors sum their features by label and bucket (a hash of source and language), and the other view is
fitted on the labelled rows and on the mean row of each bucket, weighted by its documents. At the end a logistic
combination, fitted on labelled rows kept aside, calibrates both views into one probability. This is done for quality and
toxicity; a document stays if it is probably of quality and probably not toxic.

Fitting uses at most LABELLED labelled rows (those with the smallest hashes of doc_id); the exchange of pseudo-labels and
the scores cover all documents over their whole texts. What reaches the driver are word counts and integers, bounded by
LABELLED, VOCABULARY and BUCKETS. Labels that are null are left out. A doc_id counts once in fitting, with its smallest
label and its smallest row, however often it comes. Without labels of both classes a target has no say. Null or empty
texts, sources and languages are values like others; a null n_chars is unknown length; texts of any length are read in
bounded slices. Extra columns of any name are left alone. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batch, documents, slices, stored, text_of

#: Bounds of what is fitted on: labelled rows, words of the vocabulary.
LABELLED, VOCABULARY = 12_000, 40_000
#: Rounds of exchange, what a view must be sure of, the weight of all pseudo-labelled rows against the labelled ones.
ROUNDS, SURE, PSEUDO = 3, 0.97, 0.1
#: Buckets whose mean rows stand for their documents, and slots for names of sources and languages.
BUCKETS, SLOTS = 16, 4096
_MARKS = re.compile(r"[^\w\s.,;:'\"-]")
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_LETTERS.findall(text.lower()))


def shape_of(text: str) -> list[str]:
    """The levels that measures of the whole text's shape reach."""
    n = len(text) or 1
    parts = text.split()
    lines = [x for x in text.split("\n") if x]
    upper = sum(map(str.isupper, parts)) / (len(parts) or 1)
    marks = len(_MARKS.findall(text)) / n
    levels = {
        "upper": upper * 10, "marks": marks * 100, "repeat": (1 - len(set(parts)) / (len(parts) or 1)) * 10, "lines": (1 - len(set(lines)) / (len(lines) or 1)) * 10,
        "digits": sum(map(str.isdigit, text)) / n * 40, "bars": text.count("|") / n * 100, "mean": n / (len(parts) or 1), "words": np.log2(len(parts) + 1), "links": text.count("http"),
    }
    return [f"<{name} {k}>" for name, v in levels.items() for k in range(1, min(int(v), 20) + 1)]


def _slot(name, slots: int) -> str:
    return "none" if name is None else str(xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass"), 3) % slots)


def metadata_of(source, lang, n_chars) -> list[str]:
    """Names of source and language are hashed, so that their number is bounded."""
    size, lang = "none" if n_chars is None else int(np.log2(max(0, n_chars) + 1) * 2), _slot(lang, SLOTS // 16)
    return [f"source={_slot(source, SLOTS)}", f"lang={lang}", f"size={size}", f"lang={lang} size={size}"]


class View:
    """Logistic regression on sets of features, or on their shares in a group of documents."""

    def __init__(self, weights: dict | None = None, bias: float = 0.0):
        self.weights, self.bias = weights or {}, bias

    def logit(self, features) -> float:
        get = self.weights.get
        return self.bias + sum([get(f, 0.0) for f in features])

    def fit(self, rows: list, target: np.ndarray, weight: np.ndarray, steps: int = 200, ridge: float = 1e-4) -> View:
        """rows: features of each row, as a list (each is 1) or as a dictionary of values."""
        names: dict = {}
        lengths = np.array([len(r) for r in rows])
        index = np.array([names.setdefault(f, len(names)) for r in rows for f in r], dtype=np.int64)
        value = np.array([x for r in rows for x in (r.values() if isinstance(r, dict) else (1.0,) * len(r))], dtype=float)
        row = np.repeat(np.arange(len(rows)), lengths)
        w, b, total = np.zeros(len(names)), 0.0, weight.sum()
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for t in range(1, steps + 1):
            z = np.bincount(row, weights=w[index] * value, minlength=len(rows)) + b
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight / total
            g = np.r_[np.bincount(index, weights=error[row] * value, minlength=len(w)) + ridge * w, error.sum()]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.15 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
            w, b = w - step[:-1], b - step[-1]
        self.weights, self.bias = dict(zip(names, w.tolist(), strict=True)), float(b)
        return self


def telling(rows: list, target: np.ndarray, least: float = 4.0) -> set[str]:
    """Features whose share differs between the classes by so many standard errors: chance words would only add noise."""
    n1, n0 = max(1.0, target.sum()), max(1.0, (1 - target).sum())
    with_it, without = Counter(), Counter()
    for r, y in zip(rows, target.tolist(), strict=True):
        (with_it if y else without).update(r)
    out = set()
    for f in with_it.keys() | without.keys():
        p = (with_it[f] + without[f] + 1) / (n1 + n0 + 2)
        if abs(with_it[f] / n1 - without[f] / n0) >= least * (p * (1 - p) * (1 / n1 + 1 / n0)) ** 0.5:
            out.add(f)
    return out


def combined(z: np.ndarray, target: np.ndarray, steps: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Weights (bias first) of a logistic combination of the columns of z, none below 0.

    Newton steps on standardised columns with a small penalty; a step is halved until the loss falls, so nearly
    separated classes don't throw it off.
    """
    scale = np.maximum(z.std(axis=0), 1e-9)
    x, w = np.c_[np.ones(len(z)), z / scale], np.zeros(z.shape[1] + 1)

    def loss(v: np.ndarray) -> float:
        u = x @ v
        return float(np.logaddexp(0, u).sum() - target @ u + ridge / 2 * (v[1:] ** 2).sum())

    now, pull = loss(w), np.r_[0.0, np.full(z.shape[1], ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-6), x.T @ (p - target) + pull * w)
        size = 1.0
        while size > 1e-6:
            new = w - size * step
            new[1:] = np.maximum(new[1:], 0)
            if (value := loss(new)) < now - 1e-9:
                break
            size /= 2
        else:
            break
        w, now = new, value
    return np.r_[w[0], w[1:] / scale]


class CoTraining:
    """Both views of one target: words and metadata of labelled rows, a quarter of them kept aside for calibration."""

    def __init__(self, text: list, meta: list, target: np.ndarray):
        aside = np.arange(len(target)) % 4 == 3
        self.possible = min(target[~aside].sum(), (1 - target[~aside]).sum()) >= 1 and min(target[aside].sum(), (1 - target[aside]).sum()) >= 1
        self.kept = telling([r for r, a in zip(text, aside, strict=True) if not a], target[~aside])
        both = ([[f for f in r if f in self.kept] for r in text], meta)
        self.rows = [[r for r, a in zip(rows, aside, strict=True) if not a] for rows in both]
        self.rest = [[r for r, a in zip(rows, aside, strict=True) if a] for rows in both]
        self.target, self.rest_target, self.views = target[~aside], target[aside], [View(), View()]

    def fit(self, means: tuple[list, list]):
        """means: for each view (row, label, documents) of the buckets that the other view is sure of."""
        for k, view in enumerate(self.views):
            y, weight = np.r_[self.target, [m[1] for m in means[k]]], np.ones(len(self.target))
            mass = np.array([m[2] for m in means[k]], dtype=float)
            for label in (0.0, 1.0):
                # Pseudo-labels keep the proportion of the classes among the labelled rows.
                of = np.array([m[1] == label for m in means[k]], dtype=bool)
                if of.any():
                    mass[of] *= PSEUDO * (self.target == label).sum() / mass[of].sum()
            weight = np.r_[weight, mass]
            share = (y * weight).sum() / weight.sum()
            view.fit(self.rows[k] + [m[0] for m in means[k]], y, weight * np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5)

    def combination(self) -> np.ndarray:
        z = np.array([[v.logit(r) for v, r in zip(self.views, pair, strict=True)] for pair in zip(*self.rest, strict=True)])
        return combined(z, self.rest_target)


def _bucket(meta: str) -> int:
    return xxhash.xxh32_intdigest(meta.split("\tsize=")[0].encode(), 5) % BUCKETS


def exchanged(rows: DataFrame, models: dict[str, CoTraining], words: int) -> dict[str, tuple[list, list]]:
    """Mean rows of what each view is sure of, over all rows (words array<int>, meta string): for each target, for each
    receiving view, (row, label, documents). Sums are taken in the tasks and again by a grouping, then collected:
    2 targets x 2 views x 2 labels x BUCKETS rows of features at most."""
    plain = {}
    for name, m in models.items():
        w = np.zeros(words)
        for f, v in m.views[0].weights.items():
            w[f] = v
        plain[name] = (w, m.views[0].bias, m.views[1].weights, m.views[1].bias, np.isin(np.arange(words), list(m.kept)))
    model = rows.sparkSession.sparkContext.broadcast(plain)  # bounded by the vocabulary and the slots
    out = pa.schema([("target", pa.string()), ("view", pa.int32()), ("label", pa.int32()), ("bucket", pa.int32()), ("feature", pa.string()), ("n", pa.int64())])

    def run(batches):
        text, meta = {}, Counter()
        sure = np.log(SURE / (1 - SURE))
        for rb in batches:
            lists, coded = rb.column(0), rb.column(1).dictionary_encode()
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(rb.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            metas, of = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            bucket = np.array([_bucket(m) for m in metas], dtype=np.int64)[of]
            for name, (w, bias, weights, meta_bias, kept) in model.value.items():
                a = np.bincount(row, weights=w[flat], minlength=rb.num_rows) + bias
                b = np.array([meta_bias + sum(weights.get(f, 0.0) for f in m.split("\t")) for m in metas])[of]
                for label, yes in ((1, a >= sure), (0, a <= -sure)):
                    for i, n in zip(*np.unique(of[yes], return_counts=True), strict=True):
                        meta[name, label, metas[i]] += int(n)
                for label, yes in ((1, b >= sure), (0, b <= -sure)):
                    used = yes[row] & kept[flat]
                    key = (name, label)
                    if key not in text:
                        text[key] = np.zeros(BUCKETS * (words + 1), dtype=np.int64)
                    text[key] += np.bincount(bucket[row[used]] * (words + 1) + flat[used], minlength=BUCKETS * (words + 1))
                    text[key] += np.bincount(bucket[yes] * (words + 1) + words, minlength=BUCKETS * (words + 1))
        sums = Counter()
        for (name, label, m), n in meta.items():
            for f in (*m.split("\t"), ""):
                sums[name, label, _bucket(m), f] += n
        found = [(name, 1, label, b, f, n) for (name, label, b, f), n in sums.items()]
        for (name, label), counts in text.items():
            for i in np.flatnonzero(counts).tolist():
                b, f = divmod(i, words + 1)
                found.append((name, 0, label, b, "" if f == words else str(f), int(counts[i])))
        for i in range(0, len(found), 50_000):
            yield batch(out, *zip(*found[i : i + 50_000], strict=True))

    kind = "target string, view int, label int, bucket int, feature string, n long"
    total = rows.select("words", "meta").mapInArrow(run, kind).groupBy("target", "view", "label", "bucket", "feature").agg(F.sum("n").alias("n"))
    groups: dict[tuple, dict] = {}
    for target, view, label, b, f, n in sorted(zip(*(c.to_pylist() for c in total.toArrow().columns), strict=True)):
        groups.setdefault((target, view, label, b), {})[f] = n
    means = {name: ([], []) for name in models}
    for (target, view, label, _), row in groups.items():
        n = row.pop("")
        means[target][view].append(({(int(f) if view == 0 else f): v / n for f, v in row.items()}, float(label), n))
    return means


class Scorer:
    """Probabilities of quality and toxicity of a document."""

    def __init__(self, models: dict[str, tuple[View, View, np.ndarray] | None]):
        self.models = {k: m for k, m in models.items() if m}

    def score(self, text: str, source, lang, n_chars) -> tuple[float, float]:
        words = [*words_of(text), *shape_of(text)]
        meta = metadata_of(source, lang, n_chars)
        out = {"quality": 1.0, "toxic": 0.0}
        for name, (a, b, w) in self.models.items():
            z = w[0] + w[1] * a.logit(words) + w[2] * b.logit(meta)
            out[name] = float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
        return out["quality"], out["toxic"]


def _columns(docs: DataFrame) -> list:
    named = lambda c, kind: (docs[c] if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    return [docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), named("source", "string"), named("lang", "string"), named("n_chars", "long")]


def _featured(plain: DataFrame, vocabulary: dict[str, int] | None) -> DataFrame:
    """plain with the words of the whole text (names, or numbers of those in the vocabulary) and metadata instead of it."""
    of = plain.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by VOCABULARY
    extra = [c for c in plain.columns if c not in ("doc_id", "text", "source", "lang", "n_chars")]
    kinds = {"doc_id": pa.int64(), "quality": pa.int32(), "toxic": pa.int32()}
    out = pa.schema([*((c, kinds[c]) for c in ("doc_id", *extra)), ("words", pa.list_(pa.string() if vocabulary is None else pa.int32())), ("meta", pa.string())])

    def run(batches):
        known = of.value
        for rb in batches:
            for part in slices(rb):
                words = [[*words_of(t), *shape_of(t)] for t in part["text"].to_pylist()]
                words = [sorted(w) if known is None else sorted(known[x] for x in w if x in known) for w in words]
                meta = ["\t".join(metadata_of(*m)) for m in zip(*(part[c].to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
                yield batch(out, *(part[c] for c in ("doc_id", *extra)), words, meta)

    kind = ", ".join([f"{c} {'long' if c == 'doc_id' else 'int'}" for c in ("doc_id", *extra)] + [f"words array<{'string' if vocabulary is None else 'int'}>", "meta string"])
    return plain.mapInArrow(run, kind)


def fitted(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Scorer:
    """Fit both targets on a bounded sample of labelled rows and on the sums of all documents the views are sure of."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).alias("y"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64(F.col("doc_id"), F.lit(11)), "doc_id").limit(labelled).select("doc_id", "y.quality", "y.toxic")
    known = F.broadcast(stored(known, "labels"))  # at most `labelled` rows of integers
    plain = docs.select(*_columns(docs))
    once = plain.join(known, "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("d")).select("doc_id", "d.*", "quality", "toxic")
    sample = stored(_featured(once, None), "labelled-words")
    common = sample.select(F.explode("words").alias("w")).groupBy("w").count().where("count >= 4").orderBy(F.desc("count"), "w").limit(VOCABULARY)
    names = [r.w for r in common.collect()]
    rows = sorted(_featured(once, {w: i for i, w in enumerate(names)}).toArrow().to_pylist(), key=lambda r: r["doc_id"])
    models = {}
    for name in ("quality", "toxic"):
        m = CoTraining([r["words"] for r in rows], [r["meta"].split("\t") for r in rows], np.array([r[name] for r in rows], dtype=float))
        if m.possible:
            models[name] = m
            m.fit(([], []))
    if not models:
        return Scorer({})
    kept = sorted(set().union(*(m.kept for m in models.values())))
    rest = stored(_featured(plain.join(known.select("doc_id"), "doc_id", "left_anti"), {names[i]: i for i in kept}), "unlabelled-words")
    for _ in range(rounds):
        means = exchanged(rest, models, len(names))
        for name, m in models.items():
            m.fit(means[name])
    return Scorer({k: (View({names[f]: v for f, v in m.views[0].weights.items()}, m.views[0].bias), m.views[1], m.combination()) for k, m in models.items()})


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, p_quality, p_toxic, keep for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast({k: (a.weights, a.bias, b.weights, b.bias, w.tolist()) for k, (a, b, w) in scorer.models.items()})  # bounded by the vocabulary
    out = pa.schema([("doc_id", pa.int64()), ("p_quality", pa.float64()), ("p_toxic", pa.float64())])

    def run(batches):
        own = Scorer({k: (View(a, b), View(c, d), np.array(w)) for k, (a, b, c, d, w) in model.value.items()})
        for rb in batches:
            for part in slices(rb):
                found = [own.score(*r) for r in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)]
                yield batch(out, part.column(0), [q for q, _ in found], [t for _, t in found])

    kept = (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5)
    return docs.select(*_columns(docs)).mapInArrow(run, "doc_id long, p_quality double, p_toxic double").withColumn("keep", kept)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the documents that the classifier rejects."""
    scorer = fitted(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast({k: (a.weights, a.bias, b.weights, b.bias, w.tolist()) for k, (a, b, w) in scorer.models.items()})

    @F.pandas_udf("boolean")
    def good(text, source, lang, n_chars):
        import pandas as pd

        own = Scorer({k: (View(a, b), View(c, d), np.array(w)) for k, (a, b, c, d, w) in model.value.items()})
        none = lambda v: None if pd.isna(v) else v
        marks = [own.score(t, none(s), none(g), None if pd.isna(n) else int(n)) for t, s, g, n in zip(text, source, lang, n_chars, strict=True)]
        return pd.Series([q >= 0.5 and t < 0.5 for q, t in marks], dtype=bool)

    return docs.where(good(*_columns(docs)[1:]))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
