"""Very many rows that are alike: none of them may meet in one array or one task, and no language may go missing."""

import pyarrow as pa
from pyspark.sql import functions as F

from steadfold.llm import language_id, line_dedup, mixing


def test_languages_of_copies(spark):
    english = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the cat sat on mat number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    ids = spark.range(10_000, 10_006).select(F.col("id").alias("doc_id"), F.concat(F.lit("zyx wvu tsr "), F.col("id").cast("string")).alias("text"), F.lit("xx").alias("lang"))
    copies = ids.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("n")
    for docs in (english.unionByName(ids), english.unionByName(copies), copies):
        rows = language_id.sample(docs).collect()
        kept = {r.draw for r in rows if r.lang == "xx"}
        assert len(kept) == ids.where(~language_id.held_out(F.col("doc_id"))).count() and len(rows) == len({(r.lang, r.draw) for r in rows})
        assert sum(r.lang == "en" for r in rows) in (0, language_id.DOCUMENTS)
    assert sorted(language_id.sample(english.unionByName(copies)).collect()) == sorted(language_id.sample(english.unionByName(ids)).collect())


def test_many_languages_keep_one_each(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 40)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), (F.col("id") % 40).cast("string").alias("lang"))
    assert sorted(int(r.lang) for r in language_id.sample(docs).collect()) == list(range(40))


def test_dedup_of_many_equal_rows(spark):
    text = "the same line of some words again and again\nand another line that is not like it"
    docs = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.col("id").alias("n_chars"))
    docs = docs.unionByName(spark.createDataFrame([(None, text, -1), (None, None, -2), (8, "alone here", -3)], "doc_id long, text string, n_chars long"))
    found = line_dedup.dedup(docs)
    counts = {r.text: r["count"] for r in found.groupBy("text").count().collect()}
    assert counts == {text: 1, "": 100_000, None: 1, "alone here": 1}
    assert found.agg(F.count_distinct("n_chars")).first()[0] == 100_003


def test_mixing_of_many_equal_rows(spark):
    same = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("three words here").alias("text"), F.lit("a").alias("source"))
    empty = spark.range(150_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"), F.lit("b").alias("source"))
    other = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some five words of text").alias("text"), F.lit("b").alias("source"))
    docs = same.unionByName(empty).unionByName(other)
    rows = mixing.shared(mixing.plan(docs)).withColumn("taken", F.col("size") * F.col("copies"))
    found = {r.source: r for r in rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()}
    assert found["a"].n == 100_000 and found["b"].n == 152_000
    assert abs(found["a"].taken - found["a"].target) <= 3 and abs(found["b"].taken - found["b"].target) <= 5
    assert found["a"].most - rows.where("source = 'a'").agg(F.min("copies")).first()[0] <= 1 and max(found["a"].most, found["b"].most) <= 3
    small = spark.createDataFrame([("s", 1, 5, 2, 10, 7, 30, 30.0)], "source string, doc_id long, key long, size long, rows long, copies long, source_size long, target double")
    assert sorted(r.copies for r in mixing.shared(small, piece=3).collect()) == [0] * 3 + [1] * 7


def test_shingles_of_a_bucket_that_repeats_are_taken_once(monkeypatch):
    bodies = [f"line {k % 150} of many, whose words are {k % 150 * 7919 % 1009} and {k % 150 * 104729 % 997}" + " again" * (k // 150) for k in range(300)]
    keys = [line_dedup.line_key(x) for x in bodies]
    rows = [(5, 2 * b, 0, 0, k, x) for b in range(12) for k, x in sorted(zip(keys, bodies, strict=True))]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["low", "key", "i", "j", "line", "body"])
    taken, sets_of = [], line_dedup.shingle_sets
    monkeypatch.setattr(line_dedup, "shingle_sets", lambda lines, *more: (taken.extend(lines), sets_of(lines, *more))[1])
    links = [x for found in line_dedup._compared(iter([batch])) for x in zip(*(c.to_pylist() for c in found.columns), strict=True)]
    sets = [set(s.tolist()) for s in sets_of(bodies)]
    assert sorted(taken) == sorted(bodies)
    near = {frozenset((keys[i], keys[j])) for i in range(300) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert links and {frozenset(x) for x in links} <= near

    def parts(edges):
        above = {k: k for k in keys}
        for a, b in edges:
            old, new = above[a], above[b]
            above = {k: new if v == old else v for k, v in above.items()}
        groups = {}
        for k, v in above.items():
            groups.setdefault(v, set()).add(k)
        return sorted(map(sorted, groups.values()))

    assert parts(links) == parts(map(tuple, near))
