"""Fill-in-middle: the bit vectors against plain counting, and the operator against slices of texts."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from steadfold.llm import fill_middle


@given(st.lists(st.text(alphabet=st.sampled_from("ab<PSM>éß中\U0001f600\n"), max_size=300), max_size=40))
@settings(max_examples=60, deadline=None)
def test_rank_and_select(texts):
    data = "".join(texts).encode()
    begins = [i for i, b in enumerate(data) if b & 0xC0 != 0x80]
    found = fill_middle.Boundaries(np.frombuffer(data, np.uint8))
    at = np.arange(len(data) + 1)
    assert found.rank(at).tolist() == [sum(b < i for b in begins) for i in at.tolist()]
    assert found.select(np.arange(len(begins) + 2)).tolist() == [*begins, len(data), len(data)]


def test_directory_of_many_blocks():
    text = "aé中\U0001f600" * 5000
    found = fill_middle.Boundaries(np.frombuffer(text.encode(), np.uint8))
    nth = np.arange(0, len(text), 97)
    assert found.select(nth).tolist() == [len(text[:k].encode()) for k in nth.tolist()]
    assert found.rank(np.array([10 * len("aé中\U0001f600".encode())])).tolist() == [40]


def expected(doc_id, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, len(text), "plain", None, None, text)
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}" if form == "psm" else f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return (doc_id, len(text), form, a, b - a, out)


def test_against_slices(spark, odd, none):
    tricky = ["a<P", "<P>x", "S><M", "<<S", "<S>", "<", "P>", "<M>" * 3, "\U0001f600" * 7, "é", "a\nb\r\n"] * 20
    rows = [(1000 + i, t + "z" * (i // 11)) for i, t in enumerate(tricky)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = fill_middle.transform(docs)
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found.collect()]
    assert sorted(got, key=repr) == sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = found.select("doc_id", fill_middle.restored(found["output"], found["form"]).alias("text"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, docs.na.fill("", ["text"]).collect()))
    assert fill_middle.transform(none).count() == 0


def test_rewrite_keeps_columns(spark, odd, none):
    clash = odd.withColumnRenamed("key", "output").withColumnRenamed("size", "form").withColumnRenamed("fp", "low")
    found = fill_middle.rewrite(clash, plain=0, suffix_first=100)
    assert found.columns == clash.columns and [f.dataType for f in found.schema] == [f.dataType for f in clash.schema]
    others = [c for c in clash.columns if c != "text"]
    assert sorted(map(repr, found.select(others).collect())) == sorted(map(repr, clash.select(others).collect()))
    assert all(r.text.startswith("<S>") for r in found.collect() if r.text) and fill_middle.rewrite(none).count() == 0
