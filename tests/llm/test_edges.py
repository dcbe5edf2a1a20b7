"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from steadfold.llm import decontaminate, language_id, license_scan, line_dedup, mixing, quality_rules, simhash, token_files, toxicity, url_filter

ITEMS = "item_id long, text string, doc_id long, n_words long"


def by_id(result):
    found = {}
    for r in result.collect():
        found.setdefault(r.doc_id, []).append(r)
    return found


def test_quality(odd, none):
    found = by_id(quality_rules.apply_policy(quality_rules.ledger(odd)))
    assert sum(map(len, found.values())) == odd.count() and quality_rules.ledger(none).count() == 0
    for i in (0, 1, 2):
        assert found[i][0].n_words == 0 and found[i][0].failures == 1 and not found[i][0].kept
    assert found[5][0].n_words == 60_000 and not found[5][0].kept and len(found[4]) == 3 and len(found[None]) == 2
    assert quality_rules.ablation(quality_rules.ledger(none)).count() == 0


def test_simhash(odd, none):
    found = by_id(simhash.near_duplicates(odd))
    assert sum(map(len, found.values())) == odd.count() and simhash.near_duplicates(none).count() == 0
    assert {found[i][0].component_id for i in (0, 1, 2)} == {0} and found[0][0].fp == 0
    assert {r.component_id for r in found[None] if r.fp == 0} == {0}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and simhash.keep_one(none).count() == 0
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == [0, 3, 4, 4, 5, 6, 7, 8, 9]
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["no id here"]
    nameless = odd.where("doc_id IS NULL").unionByName(odd.where("doc_id IS NULL"))
    assert sorted(map(str, (r.text for r in simhash.keep_one(nameless).collect()))) == ["None", "no id here"]


def test_tokens(odd, none, tmp_path):
    found = by_id(token_files.read_digests(*token_files.write_tokens(odd, f"file://{tmp_path}/t")))
    assert sum(map(len, found.values())) == odd.count() and found[0][0].n_tokens == found[1][0].n_tokens == 1
    starts = sorted((r.start, r.n_tokens, -1 if r.doc_id is None else r.doc_id) for v in found.values() for r in v)
    assert [s for s, _, _ in starts] == [sum(n for _, n, _ in starts[:k]) for k in range(len(starts))]
    assert [d for _, _, d in starts] == sorted(d for _, _, d in starts)
    assert token_files.read_digests(*token_files.write_tokens(none, f"file://{tmp_path}/n")).count() == 0


def test_mixing(odd, none):
    rows = mixing.plan(odd).collect()
    assert sum(r.rows for r in rows) == odd.count() and mixing.plan(none).count() == 0
    assert all(0 <= r.copies <= 3 * r.rows for r in rows)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixing.mix(none).count() == 0
    assert mixed.count() == sum(r.copies for r in rows)


def test_licences(odd, none):
    found = by_id(license_scan.scan(odd))
    assert sum(map(len, found.values())) == odd.count() and license_scan.scan(none).count() == 0
    assert (found[0][0].n_words, found[0][0].labels, found[0][0].first_word, found[0][0].score) == (0, "", None, 0)
    assert (found[7][0].n_words, found[7][0].first_word, found[7][0].base_labels) == (5, 3, "mit")
    assert found[5][0].n_words == 60_000


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "hello THERE you", None, None), (2, None, None, None), (3, "", 1, 1), (None, "words", 1, 1), (4, " ".join(f"word{k}" for k in range(30)), 1, 1), (5, "hello there you", 1, 1)], ITEMS)
    found = by_id(decontaminate.contamination(odd, items))
    assert sum(map(len, found.values())) == odd.count()
    assert decontaminate.contamination(none, items).count() == 0
    four = [r for r in found[4] if r.n_words == 10]
    assert [(r.n_hit, r.items) for r in four] == [(4, ["1", "5"])] * 2
    assert found[5][0].items == ["4"] and found[5][0].n_hit == 30 * 62
    empty = spark.createDataFrame([], ITEMS)
    assert by_id(decontaminate.contamination(odd, empty))[5][0].n_hit == 0
    assert decontaminate.keep_clean(odd, items).columns == odd.columns
    assert 5 not in {r.doc_id for r in decontaminate.keep_clean(odd, items).collect()}


def test_line_dedup(odd, none):
    found = by_id(line_dedup.removals(odd))
    assert sum(map(len, found.values())) == odd.count() and line_dedup.removals(none).count() == 0
    assert found[0][0].n_lines == 1 and found[0][0].removed == [] and found[2][0].removed == []
    assert sorted(len(r.removed) for r in found[4]) == [0, 0, 2]
    cut = line_dedup.dedup(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count() and line_dedup.dedup(none).count() == 0
    assert sorted(r.text for r in cut.collect() if r.doc_id == 4) == ["", "Hello there, you are here.\nA second line of words.", "another text under the same id"]


def test_language(odd, none):
    net = language_id.fit(odd)
    found = by_id(language_id.predictions(odd, net))
    assert sum(map(len, found.values())) == odd.count() and language_id.predictions(none, net).count() == 0
    for i in (0, 1, 2, 8, 9):
        assert (found[i][0].lang_pred, found[i][0].score) == ("und", 0)
    assert language_id.fit(none) is None
    assert {r.lang_pred for r in language_id.predictions(odd, None).collect()} == {"und"}
    kept = language_id.keep_identified(odd, net)
    assert kept.columns == odd.columns and {0, 1, 2, 8, 9}.isdisjoint(r.doc_id for r in kept.collect())


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    found = by_id(toxicity.scores(odd, model))
    assert sum(map(len, found.values())) == odd.count() and toxicity.scores(none, model).count() == 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for v in found.values() for r in v)
    assert toxicity.scores(odd, toxicity.fit(none, labels.limit(0))).count() == odd.count()


def test_urls(spark):
    captures = spark.sql("""
        SELECT * FROM VALUES (1L, 'HTTP://User@A.Bad.Example.com.:80/x/Y?q#f', timestamp '2024-05-01', 'list'), (2L, 'http://bad.example.com', timestamp '2024-03-01', 'x'),
          (3L, null, timestamp '2024-05-01', 'x'), (4L, 'no url', timestamp '2024-05-01', 'x'), (5L, 'http://bad.example.com/', null, 'x'),
          (6L, 'http://good.example.com/x/Y/z', timestamp '2024-05-01', 'x'), (6L, 'http://good.example.com/x/Y/z', timestamp '2024-05-01', 'x') AS t(page_id, url, fetched_at, entry)""")
    changes = spark.sql("""
        SELECT * FROM VALUES ('a', 'bad.example.com', 'add', timestamp '2024-04-01'), ('a', 'bad.example.com', 'remove', timestamp '2024-06-01'), ('b', 'good.example.com/x/Y', 'add', timestamp '2024-05-01'),
          ('b', 'good.example.com/x', 'remove', timestamp '2024-04-01'), (null, 'example.com', 'add', timestamp '2024-01-01'), ('c', 'example.com', 'maybe', timestamp '2024-01-01') AS t(list, entry, action, at)""")
    found = {r.page_id: (r.host, r.n_entries, r.lists, r.entry) for r in url_filter.judge(captures, changes).collect()}
    assert found == {1: ("a.bad.example.com", 1, "a", "bad.example.com"), 2: ("bad.example.com", 0, "", None), 3: (None, 0, "", None), 4: (None, 0, "", None), 5: ("bad.example.com", 0, "", None), 6: ("good.example.com", 1, "b", "good.example.com/x/Y")}
    assert url_filter.judge(captures, changes).count() == 7
    assert url_filter.judge(captures.limit(0), changes).count() == 0 and url_filter.judge(captures, changes.limit(0)).where("n_entries > 0").count() == 0


#: Names that operators give to columns of their own, or gave.
HELPERS = "key text_key ident own more body letter rid n copies rows of_source of_id of_text nth cuts removed __key __text __copies __n __id __more __rows __cut __letter item win hits u p source_size target fp root component_id".split()


def test_columns_may_have_any_name(spark):
    """Columns with every helper name, in one table: the same names, types and values come out."""
    texts = ["The quick brown fox jumps over the lazy dog near the river bank today", "Another line of plain English words which nobody has ever seen before here", "The quick brown fox jumps over the lazy dog near the river bank today", None]
    rows = [(i, t, "en", "s", 1, *(f"{h}{i}" for h in HELPERS)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{h}` string" for h in HELPERS))
    items = spark.createDataFrame([(1, "another line of plain english words which nobody has ever")], "item_id long, text string")
    whole = {r.doc_id: r for r in docs.collect()}
    net = language_id.fit(docs)
    for found, ids in ((simhash.keep_one(docs), {0, 1, 3}), (decontaminate.keep_clean(docs, items), {0, 2, 3}), (mixing.mix(docs), {0, 1, 2}), (language_id.keep_identified(docs, net), {0, 1, 2})):
        assert found.schema == docs.schema or [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in docs.schema]
        rows = found.collect()
        assert {r.doc_id for r in rows} - {3} == ids - {3} and all(r == whole[r.doc_id] for r in rows)
    cut = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    assert cut[2].text == "" and all(cut[i][2:] == whole[i][2:] for i in cut) and cut[0] == whole[0] and len(cut) == 4


@pytest.mark.parametrize("stage", ["language", "near_copies", "benchmark", "mixture"])
def test_stages_return_the_columns(spark, odd, none, stage):
    import corpus_pipeline

    run = dict(corpus_pipeline.STAGES)[stage]
    sf = "/root/testdata/sf0.001"
    found = run(spark, odd, sf)
    assert found.columns == odd.columns and [f.dataType for f in found.schema] == [f.dataType for f in odd.schema]
    assert set(found.where(F.col("doc_id").isNotNull()).select("doc_id", "text").distinct().collect()) <= set(odd.select("doc_id", "text").collect())
    assert run(spark, none, sf).count() == 0
