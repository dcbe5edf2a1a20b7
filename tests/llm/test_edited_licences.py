"""Licences with words changed or put in between: how many are found, what is found beside them, and the same in SQL."""

import random

import duckdb

from steadfold.llm import license_scan as scan

#: Every text of the family has the words of the base phrase of gpl.
BASE = {"gpl": {"gpl"}, "lgpl": {"gpl"}, "agpl": {"gpl"}}


def edited(words, share, rng):
    out = []
    for w in words:
        if rng.random() < share:
            out += [w, f"zq{rng.randint(0, 999)}"] if rng.random() < 0.5 else [f"zq{rng.randint(0, 999)}"]
        else:
            out.append(w)
    return out


def test_one_word_in_twenty(spark, tmp_path):
    rng, rows, truth = random.Random(4), [], {}
    for label, text, _ in scan.TEXTS:
        for share in (0.0, *[0.05] * 6):
            truth[len(rows)] = label
            rows.append((len(rows), " ".join(["some words before", *edited(scan.words_of(text), share, rng), "and some behind"])))
    plain = len(rows)
    words = [w for _, text, _ in scan.TEXTS for w in scan.words_of(text)]
    rows += [(plain + k, " ".join(rng.choices(words, k=300))) for k in range(20)]  # the same words in another order
    rows += [(None, None), (None, ""), (7, rows[3][1])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = scan.scan(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    labels = {r.doc_id: {x for x in r.labels.split(",") if x} for r in found if r.doc_id is not None}
    assert sum(truth[k] in labels[k] for k in truth) >= 0.9 * len(truth)
    assert all(labels[k] <= {truth[k]} | BASE.get(truth[k], set()) for k in truth if k != 7)
    assert all(labels[k] <= {"gpl", "mit", "apache"} for k in range(plain, plain + 20))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.sql(scan.SQL)
    query = scan.op7_license_scan(spark, str(tmp_path)).select(*expected.columns)
    assert sorted(map(repr, map(tuple, query.collect()))) == sorted(map(repr, expected.fetchall()))


def test_stretches_are_bounded(spark):
    """The halves of a text, with very many words between them, are not one text; a few words between them are no matter."""
    label, text, _ = max(scan.TEXTS, key=lambda x: len(scan.words_of(x[1])))
    words = scan.words_of(text)
    half = len(words) // 2
    rows = [(n, " ".join([*words[:half], *["zq"] * n, *words[half:]])) for n in (0, 5, 5000)]
    share = {r.doc_id: max((x.share for x in r.spans if x.template >= len(scan.INDEX) and x.label == label), default=0) for r in scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert share[0] == 1 and share[5] > 0.9 and share[5000] < 0.7
