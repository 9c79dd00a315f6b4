"""Tool calls, personal data, top-k search, classifier and pipeline."""

import json
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinetrace.llm import pii, quality, tool_calls, topk

SF = "/root/testdata/sf0.001"


TURNS = "conv_id long, turn long, role string, text string"
ADD = {"add": {"type": "object", "properties": {"a": {"type": ["number", "object"]}, "b": {"type": ["number", "object"], "maximum": 9}}, "required": ["a", "b"], "additionalProperties": False}}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def test_tool_calls_are_linked_ordered_and_validated(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call(("y", "add", {"a": {"$result": "x"}, "b": 2}), ("x", "add", {"b": 1.0, "a": 2}), ("z", "add", {"a": 1}))), (1, 2, "tool", json.dumps({"tool_call_id": "x", "content": 3})),
        (1, 2, "tool", json.dumps({"tool_call_id": "x", "content": 4})), (1, 3, "tool", json.dumps({"tool_call_id": "q"})), (1, 4, "assistant", call(("w", "add", {"a": {"$result": "late"}, "b": 99}))), (1, 5, "assistant", call(("late", "none", {}))),
        (2, 0, "assistant", call(("a", "add", {"a": {"$result": "b"}, "b": 1}), ("b", "add", {"a": {"$result": "a"}, "b": 1}))), (2, 0, "assistant", call(("a", "add", {"a": {"$result": "b"}, "b": 1}), ("b", "add", {"a": {"$result": "a"}, "b": 1}))),
        (None, None, None, None), (3, 0, "assistant", "{broken"), (3, 1, "assistant", json.dumps({"tool_calls": [5, {"id": "s", "function": {"name": "add", "arguments": "{nope"}}]})),
    ]
    out = tool_calls.linked(tool_calls.events(spark.createDataFrame(rows, TURNS), ADD)).collect()
    by = {(r.conv_id, r.kind, r.call_id, r.body if r.call_id == "x" and r.kind == "result" else ""): r for r in out}
    assert [r.call_id for r in sorted((r for r in out if r.conv_id == 1 and r.turn == 1), key=lambda r: r.position)] == ["x", "z", "y"]
    assert (by[1, "call", "x", ""].status, by[1, "call", "x", ""].partner_turn) == ("linked", 2)
    assert by[1, "call", "x", ""].body == '{"arguments":{"a":2,"b":1},"id":"x","name":"add","role":"assistant"}'
    assert sorted(r.status for r in out if r.kind == "result" and r.call_id == "x") == ["duplicate", "linked"]
    assert by[1, "result", "q", ""].status == "orphan" and by[1, "call", "z", ""].problems == ["$.b: missing"]
    assert by[1, "call", "w", ""].problems == ["$.b: out of bounds", "unknown reference late"] and by[1, "call", "late", ""].problems == ["no schema"]
    assert [r.problems for r in out if r.conv_id == 2] == [["cycle"], ["cycle"]]
    assert by[3, "call", "s", ""].problems == ["$: arguments are no JSON"]
    empty = spark.createDataFrame([], TURNS)
    assert tool_calls.linked(tool_calls.events(empty, ADD)).count() == 0


def test_tool_calls_awkward(spark):
    deep = '{"tool_calls":[{"id":"d","name":"add","arguments":' + '{"a":' * 1500 + "1" + "}" * 1500 + "}]}"
    rows = [
        (1, 0, "assistant", deep), (1, 1, "tool", '{"tool_call_id":"\\ud800","content":"\\udfff"}'), (1, 2, "assistant", '\n {"tool_calls":[{"id":"\\ud800","name":"add","arguments":{"a":1,"b":2}}]}'),
        (1, 3, "tool", '{"tool_call_id":"n","content":NaN}'), (1, 4, "tool", '{"tool_call_id":"n","content":1e999}'), (1, 5, "assistant", call(("u", "odd", 3))), (1, 6, "user", "x" * 500_000), (1, 7, "user", ""), (None, 8, None, None),
    ]
    df = spark.createDataFrame([(*r, "k", "d", "p") for r in rows], TURNS + ", kind string, digest string, problems string")
    out = {r.turn: r for r in tool_calls.linked(tool_calls.events(df, {**ADD, "odd": {"type": ["integer", "date"], "format": "x"}})).collect()}
    assert len(out) == 9 and (out[0].kind, out[0].problems) == ("message", ["nested too deeply"])
    assert out[1].call_id == "\\ud800" and out[1].body == '{"content":"\\udfff","role":"tool","tool_call_id":"\\\\ud800"}'
    assert (out[2].kind, out[2].status, out[2].problems) == ("call", "early-result", [])
    assert out[3].kind == out[4].kind == "message" and json.loads(out[3].body)["content"] == rows[3][3]
    assert out[5].problems == ["$: unsupported keyword format", "$: unsupported type date"]
    assert json.loads(out[6].body)["content"] == "x" * 500_000 and json.loads(out[7].body)["content"] == "" and out[8].role == ""


def test_long_chain_of_calls_is_ordered():
    n = 20_000
    order, cyclic = tool_calls.ordered([(str(i), [str(i + 1)]) for i in range(n)])
    assert order == list(range(n - 1, -1, -1)) and not cyclic
    assert tool_calls.ordered([("a", ["b"]), ("b", ["a"]), ("c", ["a"]), ("d", [])]) == ([3, 0, 1, 2], {0, 1, 2})


@pytest.mark.parametrize(("value", "schema", "broken"), [
    ("ab", {"pattern": "^b"}, True), ("ab", {"pattern": "b"}, False), (1, {"enum": [True]}, True), (1.0, {"const": 1}, False), (3, {"exclusiveMaximum": 3}, True), (0.3, {"multipleOf": 0.1}, False), (7, {"multipleOf": 2}, True),
    ([1, 1.0], {"uniqueItems": True}, True), ({"a": 1, "z": "s"}, {"properties": {"a": {}}, "additionalProperties": {"type": "integer"}}, True), (5, {"anyOf": [{"type": "string"}, {"minimum": 4}]}, False),
    (5, {"oneOf": [{"type": "integer"}, {"minimum": 4}]}, True), (5, {"not": {"type": "integer"}}, True), ({"n": {"n": 3}}, {"$defs": {"t": {"properties": {"n": {"type": "object"}}}}, "$ref": "#/$defs/t"}, False),
    ([[["x"]]], {"items": {"$ref": "#"}, "type": "array"}, True), ({}, {"minProperties": 1}, True), (1, {"allOf": [{"minimum": 0}, {"maximum": 0}]}, True), (1, {"$ref": "#/none"}, True), (1, False, True),
])
def test_schema_keywords(value, schema, broken):
    assert bool(tool_calls.violations(value, schema)) == broken


def test_all_turns_of_the_table_are_events(spark):
    out = tool_calls.op2_tool_calls(spark, SF)
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    assert out.count() == turns.count()
    want = {(r.conv_id, r.turn) for r in turns.collect() if r.role == "user"} & {(r.conv_id, r.turn - 1) for r in turns.collect() if r.role == "assistant"}
    assert {(r.conv_id, r.turn) for r in out.where("kind = 'call' and status = 'linked'").collect()} == want
    parts = tool_calls.assembled(tool_calls.linked(tool_calls.events(turns, {}, True)), 2).collect()
    assert all(json.loads(r.json) for r in parts)


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-(2**50), 2**50), st.floats(allow_nan=False, allow_infinity=False), st.text()), lambda c: st.one_of(st.lists(c), st.dictionaries(st.text(), c)), max_leaves=10))
def test_canonical_json_is_stable(value):
    once = tool_calls.canonical(value)
    assert tool_calls.canonical(json.loads(once)) == once and json.loads(once) == value


def plain_spans(t):
    out = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if not (k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(alphabet="0123456789.- @+()ab_%é\n"), st.text(alphabet="a.@-b"), st.text(alphabet="0123456789 -", min_size=12), st.text(alphabet="+0123456789 ()")))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_span_field_on_held_out_sentences():
    field, hit, wrong, missed = pii.trained(), 0, 0, 0
    for text, spans in pii.generated(99, 300):
        base = pii.base_spans(text)
        got = set(pii.added_spans(text, base, field))
        want = {s for s in spans if not any(s[0] < e and s[2] > b for b, _, e in base)}
        hit, wrong, missed = hit + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.85


def test_best_path_is_the_best_of_all():
    field = pii.trained()
    for text, _ in pii.generated(5, 40):
        c = pii.Candidates(text, 0, len(text), [])
        arcs = [(i, j, field.score(f, k)) for i, j, kinds, f in c.segments for k in kinds]
        top = [0.0] * (len(c.atoms) + 1)
        for j in range(1, len(top)):
            top[j] = max([top[j - 1], *(top[i] + v for i, e, v in arcs if e == j)])
        at = {(c.atoms[i][0], c.atoms[j - 1][1]): (i, j, f) for i, j, _, f in c.segments}
        assert sum(field.score(at[s, e][2], k) for s, k, e in field.best(c)) == pytest.approx(top[-1])


def test_pii_awkward(awkward):
    rows = pii.find_pii(awkward).collect()
    assert len(rows) == awkward.count() and pii.find_pii(awkward.limit(0)).count() == 0
    clean = pii.redacted_texts(awkward)
    assert clean.columns == awkward.columns and clean.count() == awkward.count()
    assert pii.redact("a b@c.de, +1 (555) 123-4567!", pii.base_spans("a b@c.de, +1 (555) 123-4567!")) == "a [EMAIL], [PHONE]!"


def test_pii_digests(spark):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pii.op6_pii(spark, SF).collect():
        own = plain_spans(texts[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in own)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in own) for i in range(4))
        assert set(joined.split(",")) <= set(r.spans.split(","))


@pytest.mark.parametrize("sizes", [(8192, 512, 8), (16, 3, 2)])
def test_top_k_against_brute_force(spark, monkeypatch, sizes):
    for name, v in zip(("SITE", "ASKED", "GROUP"), sizes, strict=True):
        monkeypatch.setattr(topk, name, v)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(120, 8)), 1)
    x[60:80] = x[40:60]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (250, [1.0, None]), (300, [float("nan")] * 8), (None, [1.0] * 8)], "vec_id long, embedding array<double>")
    rows = topk.whole(df)
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in topk.top_k(rows, rows.where("id % 50 = 0")).collect()}
    y = np.floor(256 * x)
    for q in (0, 50, 100):
        s = sorted(((-float(y[q] @ y[i]), i) for i in range(120) if i != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, int(-v)) for v, i in s]
    assert len(got) == 15


def test_survivors_hold_all_best_rows():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(4000, 64)))
    x[:500] -= 200  # negative scores too
    q = x[::100]
    own, cuts = np.arange(0, 4000, 100)[:, None] == np.arange(4000), topk._cuts(64, 4)
    full = np.where(own, -np.inf, q @ x.T)
    cutoff = np.sort(full, axis=1)[:, -5] * 0.98 - 1
    i, j, score, computed = topk.survivors(q, x, cutoff, own, cuts)
    assert (score == full[i, j]).all() and len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(i)
    assert set(zip(*np.nonzero(full >= cutoff[:, None]), strict=True)) <= set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(i) < 0.01 * own.size and computed <= own.size * len(cuts)
    # Rows that come in groups drop out early, and their later lists are not computed.
    y = np.floor(x[rng.integers(0, 40, 4000)] + 20 * rng.normal(size=x.shape))
    full = np.where(own, -np.inf, y[::100] @ y.T)
    i, j, score, computed = topk.survivors(y[::100], y, np.sort(full, axis=1)[:, -5], own, cuts)
    assert (score == full[i, j]).all() and len(i) >= 5 * 40 and computed < 0.8 * own.size * len(cuts)
    cutoff[:] = -np.inf
    assert len(topk.survivors(q, x, cutoff, own, cuts)[0]) == (~own).sum()


def test_top_k_takes_clashing_columns_and_repeats(spark):
    rows = [(0, [1.0, 2.0], 1, 9), (50, [3.0, 1.0], 1, 9), (50, [3.0, 1.0], 1, 9), (7, [], 1, 9), (8, [1.0, None], 1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, score long")
    whole = topk.whole(df)
    got = [(r.query_id, r["rank"], r.id, r.score) for r in topk.top_k(whole, whole.where("id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50, 327680), (0, 2, 50, 327680), (50, 1, 0, 327680)]


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    rows = topk.whole(df)
    assert [(r.query_id, r.id) for r in topk.top_k(rows, rows.where("id = 0")).collect()] == [(0, 1)]
    assert topk.top_k(rows.limit(0), rows.limit(0)).count() == 0


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = quality.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    scorer = quality.fitted(docs, labels.where("doc_id % 4 <> 1"))
    got = quality.scored(docs, scorer).join(labels.where("doc_id % 4 = 1"), "doc_id").toPandas()
    assert ((got.p_quality >= 0.5) == (got.quality == 1)).mean() > 0.9
    assert ((got.p_toxic >= 0.5) == (got.toxic == 1)).mean() > 0.85
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == quality.op10_quality(spark, sf).where("keep").count()


def test_exchange_sums_all_rows_that_a_view_is_sure_of(spark):
    """Means of the exchange against a plain computation over every row."""
    words = [["a", "b"], ["b"], ["c"], [], ["a", "c"]] * 8
    meta = [["source=1", "lang=1", "size=3", "lang=1 size=3"], ["source=2", "lang=1", "size=4", "lang=1 size=4"]] * 20
    y = np.array([1.0, 1, 0, 0, 1] * 8)
    m = quality.CoTraining([["abc".index(w) for w in r] for r in words], meta, y)
    m.kept = {0, 1, 2}
    m.views = [quality.View({0: 6.0, 2: -7.0}, 0.0), quality.View({"source=1": 5.0, "source=2": -5.0}, 0.0)]
    df = spark.createDataFrame([(["abc".index(w) for w in r], "\t".join(x)) for r, x in zip(words, meta, strict=True)], "words array<int>, meta string").repartition(5)
    got = quality.exchanged(df, {"quality": m}, 3)["quality"]
    for view in (0, 1):
        want = {}
        for r, x in zip(words, meta, strict=True):
            z = 6.0 * ("a" in r) - 7.0 * ("c" in r) if view else 5.0 * (x[0] == "source=1") - 5.0 * (x[0] == "source=2")
            if abs(z) >= np.log(0.97 / 0.03):
                n, sums = want.setdefault((float(z > 0), quality._bucket("\t".join(x))), [0, {}])
                want[float(z > 0), quality._bucket("\t".join(x))][0] += 1
                for f in x if view else ["abc".index(w) for w in r]:
                    sums[f] = sums.get(f, 0) + 1
        assert sorted((y, n, sorted(r.items())) for r, y, n in got[view]) == sorted((y, n, sorted((f, v / n) for f, v in s.items())) for (y, _), (n, s) in want.items())


def test_calibration_of_separated_classes():
    """Widely separated scores must not throw the calibration off."""
    rng = np.random.default_rng(1)
    y = (rng.random(2000) < 0.85).astype(float)
    z = np.c_[np.where(y > 0, 16.0, -30.0) + rng.normal(size=2000) * 5, rng.normal(size=2000)]
    w = quality.combined(z, y)
    assert (((w[0] + z @ w[1:]) > 0) == (y > 0)).mean() > 0.99 and (w[1:] >= 0).all()


def test_classifier_awkward(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, 1), (6, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        out = quality.scored(awkward, quality.fitted(awkward, labels)).collect()
        assert len(out) == awkward.count() and all(r.keep for r in out)
    assert quality.keep_good(awkward.limit(0), one).count() == 0


def test_pipeline_equals_its_stages_done_plainly(spark):
    """Each stage against a plain computation on its own input."""
    import corpus_pipeline as C

    docs, sizes = quality.documents(spark, SF), []
    for name, stage in C.STAGES:
        before = docs.toPandas()
        docs = C.shared.stored(stage(spark, docs, SF), "test-stage")
        after = docs.toPandas()
        sizes.append(len(after))
        if name != "packing":
            assert list(after.columns) == list(before.columns)
        if name == "exact dedup":
            norm = before.text.str.replace(r"[\x20\x09-\x0D]+", " ", regex=True)
            assert set(after.doc_id) == set(before.groupby(norm).doc_id.min())
        if name == "near dedup":
            from test_dedup import _brute_components

            want, _ = _brute_components(list(zip(before.doc_id.tolist(), before.text.tolist(), strict=True)))
            assert set(after.doc_id) == set(want.values())
        if name == "personal data":
            assert not any(pii.base_spans(t) for t in after.text if "[" not in t)
        if name == "packing":
            assert set(after.doc_id) == set(before.doc_id)
    assert sizes[0] > 0.5 * quality.documents(spark, SF).count()


def test_reach_equals_a_pass_over_all_spans():
    rng = np.random.default_rng(5)
    for _ in range(200):
        spans = [(int(s), int(s + n)) for s, n in zip(rng.integers(0, 40, 6), rng.integers(1, 15, 6), strict=True)]
        a, b = sorted(rng.choice(60, 2, replace=False).tolist())
        reach = pii.Reach(spans)
        assert (reach.end_before(b) > a) == any(a < e and b > s for s, e in spans)
        assert (reach.end_before(a + 1) >= b) == any(s <= a and b <= e for s, e in spans)
        assert sorted(reach.between(a, b)) == sorted(x for x in spans if x[0] < b and x[1] > a)


def test_long_text_of_many_addresses():
    text = "".join(f"some words to user{i} at mail dot example, or user{i}@mail.example.org on\n" for i in range(14_000))
    base = pii.base_spans(text)
    assert len(text) > 1_000_000 and len(base) == 14_000
    pii.added_spans(text, base, pii.trained())
