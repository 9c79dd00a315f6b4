"""Exact, near and line dedup against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinetrace.llm import exact_dedup as X
from kinetrace.llm import line_dedup as L
from kinetrace.llm import simhash as S
from kinetrace.llm.shared import documents

SF = "/root/testdata/sf0.001"



def test_exact_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    got = X.op1_exact_dedup(spark, SF)
    want = con.sql(X.ORACLE)
    cols = sorted(got.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(want.select(*cols).fetchall())


def test_exact_awkward(awkward):
    out = X.exact_dedup(awkward)
    rows = out.collect()
    assert len(rows) == awkward.count()
    same = [r for r in rows if r.group_size == 4 and r.keep_id == 1]
    assert len(same) == 4 and sum(r.kept for r in same) == 1
    assert all(sum(r.kept for r in rows if r.text_sha256 == s) == 1 for s in {r.text_sha256 for r in rows})
    assert out.limit(0).count() == 0 and X.exact_dedup(awkward.limit(0)).count() == 0


def test_exact_tells_clashing_digests_apart(awkward):
    whole = X.exact_dedup(awkward)
    clash = X.exact_dedup(awkward, digest=lambda c: F.lit("same"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, clash.collect()))


def test_state_goes_on_over_restarts(spark, tmp_path):
    from kinetrace.llm.shared import fresh_path

    make = lambda ids: spark.createDataFrame([("d", i, i, "f") for i in ids], "digest string, ord long, rid long, file string")
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", X.ROCKS)
    ck, src = fresh_path(spark, "restart"), str(tmp_path / "in")
    for ids in ([5, 7], [3], [9]):
        make(ids).write.mode("append").parquet(src)
        X.digest_state(own.readStream.schema("digest string, ord long, rid long, file string").parquet(src), ck)
    r = X.read_state(spark, ck).first()
    assert (r["first"].ord, r.n) == (3, 4)


def test_keep_first_keeps_columns_and_one_row(awkward):
    kept = X.keep_first(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == X.exact_dedup(awkward).where("kept").count()


def brute_components(fps, ids, radius=3):
    n = len(fps)
    parent = list(range(n))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least.get(root(i)) for i in range(n)]


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash_against_brute_force(spark):
    rows = documents(spark, SF).select("doc_id", "text").collect()
    fps, ids = [plain_fingerprint(r.text) for r in rows], [r.doc_id for r in rows]
    want = {(i, f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_components(fps, ids), strict=True)}
    assert {tuple(r) for r in S.op4_simhash(spark, SF).collect()} == want


def test_simhash_awkward(awkward):
    out = {(r.doc_id, r.fp): r.component_id for r in S.near_dedup(awkward).collect()}
    assert out[3, 0] == 3 and out[4, 0] == 3 and out[5, 0] == 3 and out[None, 0] == 3
    assert S.near_dedup(awkward.limit(0)).count() == 0
    kept = S.keep_one(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect() if r.doc_id} == {1, 3, 6, 8}


@pytest.mark.parametrize("part", [4096, 8])
def test_links_in_dense_and_split_shards(spark, monkeypatch, part):
    """Many fingerprints around a few centres; with small parts every shard is split among tasks."""
    monkeypatch.setattr(S, "PART", part)
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 6)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 5))) for c in centres for _ in range(40)})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in S.components(S.linked(nodes, len(fps))).collect()}
    want = brute_components(fps, list(range(len(fps))))
    assert [fps.index(roots.get(f, f)) for f in fps] == want


def test_forest_finds_all_within_radius():
    rng = np.random.default_rng(2)
    fp, group = rng.integers(0, 1 << 12, 300).astype(np.uint64), np.repeat([0, 1, 2], 100)
    got = {(int(a), int(b)) for x, y in S.Forest(fp, group, 3).within(fp, group) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(300) for j in range(300) if group[i] == group[j] and bin(int(fp[i] ^ fp[j])).count("1") <= 3}
    assert got == want


def test_more_blocks_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    a = [int(x) for x in rng.integers(0, 1 << 63, 50)]
    b = [x ^ (1 << int(p)) ^ (1 << int(q)) ^ (1 << int(r)) for x, (p, q, r) in zip(a, rng.integers(0, 63, (50, 3)), strict=True)]
    nodes = spark.createDataFrame([(f,) for f in sorted({*a, *b})], "fp long")
    for n in (100, 1 << 40):
        links = {frozenset((r.u, r.v)) for r in S.linked(nodes, n).collect()}
        assert all(x == y or frozenset((x, y)) in links for x, y in zip(a, b, strict=True))


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    assert {r.node: r.root for r in S.components(e).collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}


def plain_units(text, words=20):
    """(normalised unit, start, end): whole lines, and from each sentence start the shortest run of enough words."""
    sentences, lines = [], []
    for line in re.finditer(r"[^\n]+", text):
        own = []
        for m in re.finditer(r"(?:(?![.!?][ \t]).)+(?:[.!?](?=[ \t]))?", line[0], re.S):
            body = m[0].strip(" \t") if own else m[0].rstrip(" \t")
            if body.strip():
                at = line.start() + m.start() + m[0].index(body)
                own.append((at, at + len(body)))
        if own:
            sentences += own
            lines.append((own[0][0], own[-1][1]))
    norm = lambda a, b: " ".join(text[a:b].lower().split())
    out = {(norm(a, b), a, b) for a, b in lines}
    for i, (a, _) in enumerate(sentences):
        for _, b in sentences[i:]:
            if len(norm(a, b).split()) >= words:
                out.add((norm(a, b), a, b))
                break
    return out


def test_units_against_plain_ones():
    from hashlib import blake2b

    texts = ["One two. Three four!\nFive six? Seven " + "word " * 25 + "end. Last one.\n\nA line", "", "single", "A.\nB.\nA.\n" + "x y z. " * 12]
    for t in texts:
        want = {(blake2b(u.encode(), digest_size=16).digest(), s, e) for u, s, e in plain_units(t)}
        assert set(L.units(t)) == want


def test_repeats_among_rows_without_an_id_are_removed(spark):
    docs = spark.createDataFrame([(None, "Shared line of text.\nOne own."), (None, "Shared line of text.\nTwo own."), (4, "Four.\nSame here."), (4, "Other.\nSame here.")], "doc_id long, text string")
    texts = [r.text for r in L.line_dedup(docs).collect()]
    assert sum("Shared" in t for t in texts) == 1 and sum("Same" in t for t in texts) == 1
    assert all(any(own in t for t in texts) for own in ("One own.", "Two own.", "Four.", "Other."))


def test_lines_against_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in documents(spark, SF).select("doc_id", "text").collect())
    got = {r.doc_id: (r.text, r.removed) for r in L.op5_line_dedup(spark, SF).collect()}
    seen = set()
    for i, t in rows:
        own, spans = set(), []
        for d, s, e in L.units(t):
            if d in seen or d in own:
                spans.append((s, e))
            own.add(d)
        seen |= own
        text, wide = L.without(t, spans)
        assert got[i] == (text, ",".join(f"{s}:{e}" for s, e in wide))


def test_planted_passage_is_removed_and_clean_text_is_not(spark):
    passage = " ".join(f"Alpha{i} beta{i} gamma{i} delta{i} one two three four five." for i in range(8))
    docs = spark.createDataFrame([(1, "First words of their own are here and stay. " + passage), (2, "Other start of a text that is new\nand has lines. " + passage + " An end that nobody else has in any text."), (3, "Clean text with nothing that others have in common at all.")], "doc_id long, text string")
    out = {r.doc_id: r for r in L.line_dedup(docs).collect()}
    assert out[1].n_removed == 0 and out[3].n_removed == 0
    assert out[2].text == "Other start of a text that is new\nand has lines. An end that nobody else has in any text."
    s, e = map(int, out[2].removed.split(":"))
    assert docs.where("doc_id = 2").first().text[s:e].strip() == passage


def test_lines_awkward(awkward):
    out = L.line_dedup(awkward)
    assert out.count() == awkward.count() and L.line_dedup(awkward.limit(0)).count() == 0


def _brute_components(texts):
    """doc_id to the smallest doc_id that links of similarity >= 0.8 reach; shingles kept as tuples of words."""
    from collections import Counter, defaultdict

    sets, holders = {}, defaultdict(list)
    for i, t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in sets[i]:
            holders[s].append(i)
    of, pairs = {i: i for i in sets}, 0

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, own in sets.items():
        for j, n in Counter(j for s in own for j in holders[s] if j > i).items():
            if n / (len(own) + len(sets[j]) - n) >= 0.8:
                pairs += 1
                a, b = sorted((root(i), root(j)))
                of[b] = a
    return {i: root(i) for i in of}, pairs


@pytest.mark.parametrize("part,named", [(2048, 4), (8, 1)])
def test_near_copies_against_brute_force(spark, part, named):
    """Edited copies of 0.8 to 0.95, further from each other than 3 bits; small parts and few names lose none."""
    from kinetrace.llm import near_copies as N

    rng = np.random.default_rng(3)
    rows = []
    for base in range(12):
        words = [f"w{rng.integers(5000)}" for _ in range(160)]
        for _ in range(8):
            copy = list(words)
            for at in rng.choice(160, rng.integers(0, 6), replace=False):
                copy[at] = f"x{rng.integers(9999)}"
            rows.append((len(rows), " ".join(copy)))
    want, pairs = _brute_components(rows)
    assert pairs > 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_copies(docs, part=part, named=named).collect()}
    assert got == want
    assert {r.doc_id for r in N.keep_one(docs).collect()} == set(want.values())


def test_pipeline_stage_takes_near_copies(spark):
    import corpus_pipeline

    words = [f"word{i}" for i in range(120)]
    near, far = list(words), list(words)
    near[60] = near[20] = "other"
    far[::12] = ["other"] * 10
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.dissimilar_documents(spark, docs, SF).collect()) == [1, 3]


def test_near_copies_awkward(awkward):
    from kinetrace.llm import near_copies as N

    kept = N.keep_one(awkward)
    rows = kept.collect()
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 3, 6, 8]
    assert N.keep_one(awkward.limit(0)).count() == 0


def test_short_lines_before_different_text_are_units(spark):
    one, two = "All rights reserved.\nthe first text goes on with many words of its own", "other words stand here before the line of rights\nAll rights reserved.\nand something else that no text repeats follows it"
    rows = {r.doc_id: r for r in L.line_dedup(spark.createDataFrame([(1, one), (2, two), (3, "All rights reserved.")], "doc_id long, text string")).collect()}
    assert rows[1].text == one and rows[3].text == ""
    assert "rights reserved" not in rows[2].text and rows[2].text.endswith("and something else that no text repeats follows it")


def test_large_group_of_near_copies_stays_linear():
    """All pairs of 3,000 fingerprints are within the radius: a spanning forest comes back, in bounded memory."""
    import tracemalloc

    from kinetrace.llm import near_copies as N

    n = 3000
    rng = np.random.default_rng(5)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for _ in range(n)], dtype=np.uint64)
    every = np.ones(n, dtype=bool)
    tracemalloc.start()
    child, root = N.near_links(np.uint64(0x0123456789ABCDEF) ^ flips, np.zeros(n, dtype=np.int64), every, every, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(child) == n - 1 and set(root) == {0}
    assert peak < 60 << 20


def test_sets_alike_against_brute_force(monkeypatch):
    from kinetrace.llm import near_copies as N

    monkeypatch.setattr(N, "COLUMNS", 7)
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 50, rng.integers(0, 30)).astype(np.uint64)) for _ in range(40)]
    sets += [s[:-1] for s in sets] + [np.r_[s, np.uint64(99)] for s in sets]
    tree, ask = np.arange(120) % 3 > 0, np.arange(120) % 5 > 0
    child, root = N.alike(sets, tree, ask)
    of = list(range(120))
    for i in np.flatnonzero(ask):
        for j in np.flatnonzero(tree):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8 and of[i] != of[j]:
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    got = list(range(120))
    for i, j in zip(child.tolist(), root.tolist(), strict=True):
        got[i] = j
    assert got == of
