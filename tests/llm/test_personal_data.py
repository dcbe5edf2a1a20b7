"""Personal data: patterns against plain regular expressions, the field against enumeration, and held-out accuracy."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from steadfold.llm import personal_data as pd
from steadfold.llm.personal_examples import examples


def plain_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


@given(st.lists(st.sampled_from(["a", "Z9", "@", "@", ".", ".", "-", "_", "%", "+", "+1", " ", "(", ")", "\n", "é", "\U0001f600", "0", "25", "256", "255", "1.2.3.4", "4111 1111 1111 1111", "5500000000000004", "x@y.z", "+1 (555) 123-4567", "٣", "\t"]), max_size=40).map("".join))
@settings(max_examples=500, deadline=None)
def test_patterns(text):
    assert pd.base_spans(text) == plain_spans(text)


def test_patterns_are_linear():
    for unit in ("x", "a@", "1", "1.", "1 ", "+", "+1", "+1 ", "a.", "@", "1-", "(", "at "):
        text = unit * (400_000 // len(unit))
        assert isinstance(pd.base_spans(text), list)


@pytest.fixture(scope="module")
def field():
    return pd.train(examples(1600, 5))


def all_paths(emissions, follows):
    for path in itertools.product(range(pd.LABELS), repeat=len(emissions)):
        yield path, sum(e[y] for e, y in zip(emissions, path)) + sum(follows[a, b] for a, b in zip((0, *path), (*path, 0)))


def test_field_against_enumeration():
    random = np.random.default_rng(3)
    follows = random.normal(0, 1, (pd.LABELS, pd.LABELS)) + pd._allowed()
    flat, first = random.normal(0, 2, (10, pd.LABELS)), np.array([0, 4, 5, 8, 10])
    table, sizes = pd.padded(flat, first, np.arange(4))
    best, (whole, found, pairs) = pd.viterbi(table, sizes, follows), pd.marginals(table, sizes, follows)
    expected = np.zeros((pd.LABELS, pd.LABELS))
    for i in range(4):
        paths = list(all_paths(flat[first[i] : first[i + 1]], follows))
        assert tuple(best[: sizes[i], i]) == max(paths, key=lambda p: p[1])[0]
        weights = np.exp([s for _, s in paths])
        assert np.isclose(whole[i], np.log(weights.sum()))
        share = np.zeros((sizes[i], pd.LABELS))
        for (path, _), w in zip(paths, weights / weights.sum()):
            share[np.arange(sizes[i]), path] += w
            for a, b in zip((0, *path), (*path, 0)):
                expected[a, b] += w
        assert np.allclose(found[: sizes[i], i], share)
    assert np.allclose(pairs, expected)


def test_gradient_against_differences():
    random = np.random.default_rng(4)
    field = pd.Field(np.arange(5), random.normal(0, 1, (6, pd.LABELS)), random.normal(0, 1, (pd.LABELS, pd.LABELS)))
    table, sizes = pd.padded(random.normal(0, 1, (9, pd.LABELS)), np.array([0, 3, 4, 9]), np.arange(3))
    truth, _ = pd.padded(random.integers(0, pd.LABELS, 9), np.array([0, 3, 4, 9]), np.arange(3))
    loss, by_emission, by_pair = pd.gradient(field, table, sizes, truth)
    for t, i, y in ((0, 0, 1), (2, 2, 4), (4, 2, 0), (0, 1, 8)):
        more = table.copy()
        more[t, i, y] += 1e-6
        assert abs((pd.gradient(field, more, sizes, truth)[0] - loss) / 1e-6 - by_emission[t, i, y]) < 1e-4
    for a, b in ((0, 0), (0, 3), (5, 0), (4, 4)):
        follows = field.follows.copy()
        follows[a, b] += 1e-6
        assert abs((pd.gradient(pd.Field(field.codes, field.weights, follows), table, sizes, truth)[0] - loss) / 1e-6 - by_pair[a, b]) < 1e-4


def test_held_out_notations(field):
    """Other sentences than it was fitted on: at least 0.95 of the spans, and 0.95 of what it says is right."""
    right = said = wanted = 0
    for text, spans in examples(500, 77):
        found = {s for s in pd.decoded(field, text) if pd.is_valid(s[0], text[s[1] : s[2]])}
        right, said, wanted = right + len(found & set(spans)), said + len(found), wanted + len(spans)
    assert right > 0.95 * wanted and right > 0.95 * said


def test_pieces_are_independent(field):
    """What stands on other lines, or far away, changes nothing; nor does what is decoded together."""
    parts = [t.replace("\n", " ") for t, _ in examples(60, 78)]
    alone = [[(k, p[a:b]) for k, a, b in pd.decoded(field, p)] for p in parts]
    together = "\n".join(parts)
    assert [(k, together[a:b]) for k, a, b in pd.decoded(field, together)] == [x for some in alone for x in some]
    assert pd.decoded(field, together, cells=50) == pd.decoded(field, together)
    far = " und weiter so in diesem langen Satz ohne Zahlen ".join(parts[:20])
    assert pd.decoded(field, far) and all(pd.decoded(field, t) == [] for t in ("", "\n", "no numbers here", "\ud800"))


def test_cuts_between_lines(field, monkeypatch):
    texts = [None, "", "x (743) 555-3824 y\n" * 30, "jane [at] acme [dot] org", "mail a@b.c\n+1 (743) 555-3824"]
    whole = pd.spans_of(texts, field)
    monkeypatch.setattr(pd, "CHARS", 40)
    assert pd.spans_of(texts, field) == whole and len(whole[2]) == 30 and whole[3] == [(0, 0, 24, False)]
    assert whole[4] == [(0, 5, 10, True), (3, 11, 28, True)] and whole[:2] == [[], []]


def test_masks():
    text = "a@b.c or +1 (743) 555-3824."
    assert pd.masked(text, [(0, 0, 5, True), (3, 9, 26, True)]) == "<EMAIL> or <PHONE>."
    assert pd.masked("1.2.3.4111", [(1, 0, 8, True), (2, 4, 10, False)]) == "<IP>" and pd.masked(None, []) is None


def test_operator(spark, odd, none, field):
    extra = spark.createDataFrame([(i, t) for i, t in enumerate(["call (743) 555-3824 now", "IP 1[.]2[.]3[.]4 and 1.2.3.4", "é\U0001f600 x@y.zz", "version 3.0 of 2024"], 100)], "doc_id long, text string")
    docs = odd.select("doc_id", "text", "key", "labels").unionByName(extra, allowMissingColumns=True).withColumnRenamed("key", "spans").withColumnRenamed("labels", "body")
    found = {}
    for r in pd.find(docs, field).collect():
        found.setdefault(r.doc_id, []).append([tuple(s) for s in r.spans])
    assert sum(map(len, found.values())) == docs.count() and pd.find(none, field).count() == 0
    assert found[100] == [[("phone", 5, 19, False)]] and found[101] == [[("ip", 3, 16, False), ("ip", 21, 28, True)]] and found[102] == [[("email", 3, 9, True)]] and found[103] == [[]]
    assert all(found[i][0] == [] for i in (0, 1, 2, 3, 5, 6, 7, 8))
    clean = pd.redact(docs, field)
    assert clean.columns == docs.columns and [f.dataType for f in clean.schema] == [f.dataType for f in docs.schema] and pd.redact(none, field).count() == 0
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[100] == "call <PHONE> now" and texts[101] == "IP <IP> and <IP>" and texts[0] is None and texts[1] == ""


def test_fit_from_a_table(spark, none):
    empty = spark.createDataFrame([(None, [("ip", 0, 1)]), ("x", None)], "text string, spans array<struct<kind: string, start: int, end: int>>")
    assert pd.decoded(pd.fit(empty), "call (743) 555-3824") == []
    odd_kind = spark.createDataFrame([("call 7", [("name", 0, 4)])] * 3, empty.schema)
    assert pd.decoded(pd.fit(odd_kind), "call 7") == []


def test_query(spark, tmp_path):
    texts = [None, "", "call (743) 555-3824", "a@b.cc, 1.2.3.4, +1 (743) 555-3824", "300.1.1.1"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in pd.op11_personal_data(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        base = [f"{pd.KINDS[k]}:{a}:{b}" for k, a, b in plain_spans(text or "")]
        assert found[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [found[i][f"n_{k}"] for k in pd.KINDS] == [sum(b.startswith(k) for b in base) for k in pd.KINDS]
    assert found[3].spans == "email:0:6,ip:8:15,phone:17:34" and found[2].spans == "phone:5:19" and found[0].spans == ""
