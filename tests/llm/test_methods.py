"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from steadfold.llm import common, decontaminate, language_id, line_dedup, mixing, quality_rules, queries, simhash, token_files, toxicity, url_filter

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, a):
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@data
@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.sql(queries.oracle_sql()[name])
    found = queries.queries()[name](spark, SF).select(*expected.columns)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected.fetchall()))


def test_components(spark):
    random.seed(5)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(60)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    groups = Groups(600)
    for a, b in edges:
        groups.join(a, b)
    found = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: groups.find(x) for x in nodes}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("radius", [3, 5])
def test_covering_masks_miss_no_pair(radius):
    masks = simhash.covering_masks(radius, 0)
    assert len(masks) == 2 ** (radius + 1) - 1
    random.seed(1)
    for _ in range(3000):
        bits = sum(1 << b for b in random.sample(range(64), random.randint(1, radius)))
        assert any(bits & m == 0 for m in masks)


@pytest.mark.parametrize(("bucket", "radius"), [(2048, 3), (40, 3), (12, 3), (60, 5)])
def test_links_are_those_of_all_pairs(spark, bucket, radius):
    """Also where buckets are so large that they are hashed anew."""
    random.seed(2)
    centre = random.getrandbits(64)
    fps = {random.getrandbits(64) for _ in range(300)}
    for _ in range(400):
        fps.add(centre ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 5))))
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    groups = Groups(len(fps))
    for i, a in enumerate(fps):
        for j in range(i):
            if ((a ^ fps[j]) & (1 << 64) - 1).bit_count() <= radius:
                groups.join(i, j)
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius, bucket).collect()
    at, found = {f: i for i, f in enumerate(fps)}, Groups(len(fps))
    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= radius
        found.join(at[a], at[b])
    assert [found.find(i) for i in range(len(fps))] == [groups.find(i) for i in range(len(fps))]


@data
def test_fingerprints(docs):
    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in simhash.fingerprints(docs).collect():
        assert r.fp & (1 << 64) - 1 == plain(texts[r.doc_id])


@data
def test_token_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(token_files.default_tokenizer())
    folder, manifest = token_files.write_tokens(docs, f"file://{tmp_path}/tokens")
    found = token_files.read_digests(folder, manifest).orderBy("start").collect()
    start = 0
    for row, doc in zip(found, docs.orderBy("doc_id").collect(), strict=True):
        ids = [*loaded.encode(doc.text, add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shard = manifest.orderBy("base").first()
    assert token_files.read_ids(folder, shard.shard, 0).tolist() == [*loaded.encode(docs.orderBy("doc_id").first().text, add_special_tokens=False).ids, 2]


def test_pieces_have_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(token_files.default_tokenizer())
    texts = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "a \nb", "a\t \tb c", "don't 's don' t", "x.,!? y", "été   b", "a  b", "a\x1c b", "1 2a 3", "中文 中", "é e", "\U0001f600 \U0001f600!", "_a_ b_", "word" * 500 + " word", "Àb, c̀."]
    random.seed(3)
    texts += ["".join(random.choice(" ab.'\n\t1é _!") for _ in range(60)) for _ in range(300)]
    for text, ids in zip(texts, token_files.encode(texts, token_files.default_tokenizer()), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == loaded.encode(text, add_special_tokens=False).ids, text


def test_words_are_counted_by_their_borders(spark):
    random.seed(13)
    texts = [None, "", " ", "a", " a", "a ", "\x01\x02", "\x02 \x01", "a\x01\x02b c", "\u00a0 \u2003x"] + ["".join(random.choice("ab\x01\x02 \t\n\x0b\x0c\ré中\u00a0\x1c") for _ in range(random.randrange(40))) for _ in range(500)]
    found = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", mixing.n_words(F.col("text")).alias("n")).collect()
    assert {r.i: r.n for r in found} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


def test_targets_are_reshared(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300, None: 40, "e": 0}
    found = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order, weights = sorted(k for k in sizes if k) + [None], (5, 2, 1)
    weight = {k: weights[i % 3] for i, k in enumerate(order)}
    target, full = dict.fromkeys(sizes, 0.0), set()
    left = float(sum(sizes.values()))
    while left > 1e-9:
        open_ = [k for k in sizes if k not in full]
        whole = sum(weight[k] for k in open_)
        for k in open_:
            target[k] += left * weight[k] / whole
        left = 0.0
        for k in open_:
            if target[k] >= 3 * sizes[k]:
                left += target[k] - 3 * sizes[k]
                target[k] = 3.0 * sizes[k]
                full.add(k)
    assert found == pytest.approx(target)


def test_mixture_meets_targets_and_expectations(spark):
    random.seed(6)
    rows = [(i, " ".join(["w"] * random.choice([5, 20, 50, 200, 800])), f"s{i % 4}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    taken = defaultdict(float)
    for seed in range(4):
        plan = mixing.plan(docs, seed, block=16).collect()
        sums, targets = defaultdict(int), {}
        for r in plan:
            rate = r.target / r.source_size
            assert r.copies in (int(rate), int(rate) + 1)
            sums[r.source] += r.copies * r.size
            targets[r.source] = r.target
            taken[r.doc_id] += r.copies - rate
        assert all(abs(sums[s] - t) <= 0.02 * t for s, t in targets.items())
    assert abs(np.mean(list(taken.values()))) < 0.15  # copies are what they should be on average
    assert sorted(map(tuple, plan)) == sorted(map(tuple, mixing.plan(docs.repartition(7), 3, block=16).collect()))


def test_fold_against_a_loop(spark, monkeypatch):
    """One tier and one block for each source, folded pair by pair with the same draws."""
    monkeypatch.setattr(mixing, "TIERS", ())
    monkeypatch.setattr(mixing, "_TIER", "0")
    random.seed(12)
    rows = [(i, " ".join(["w"] * random.choice([3, 5, 5, 8, 13])), "ab"[i % 3 > 0]) for i in range(150)] + [(7, "w w w w w", "a"), (7, "w w w w w", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.plan(docs, 3, block=10**6).withColumn("draw", F.xxhash64(F.lit(3), "doc_id", "key")).collect()

    def hashed(*values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), h)
        return (h & (1 << 52) - 1) / (1 << 52)

    for source in "ab":
        units, expected = [], {}
        for r in found:
            if r.source == source:
                rate = r.rows * r.target / r.source_size
                rate = round(rate) if abs(rate - round(rate)) < 1e-9 else rate
                expected[r.doc_id, r.key] = int(rate)
                if rate > int(rate):
                    units.append((-r.size, r.draw, r.key, r.doc_id, rate - int(rate)))
        now = None
        for size, draw, key, ident, p in sorted(units):
            x = (-size, draw, key, ident, p)
            if now is None:
                now = x
                continue
            s, d, k, i, q = now
            a, b = min((1 - q) * s, p * x[0]), min(q * s, (1 - p) * x[0])
            if hashed(d, draw, k, key) * (a + b) < b:
                if (1 - q) * s <= p * x[0]:
                    expected[i, k] += 1
                    now = (*x[:4], p - a / x[0])
                else:
                    now = (s, d, k, i, q + a / s)
            elif q * s <= (1 - p) * x[0]:
                now = (*x[:4], p + b / x[0])
            else:
                now = (s, d, k, i, q - b / s)
                expected[ident, key] += 1
        if now:
            expected[now[3], now[2]] += hashed(now[2], now[1], b"last") < now[4]
        assert {(r.doc_id, r.key): r.copies for r in found if r.source == source} == expected


def test_ledger_ablation(spark):
    words = ["".join(chr(97 + int(c)) for c in str(k)) + "ing" for k in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["short", " ".join(words), " ".join(f"### {w}" for w in words), "### a"])], "doc_id long, text string")
    rows = quality_rules.ledger(docs)
    assert [r.kept for r in quality_rules.apply_policy(rows).orderBy("doc_id").collect()] == [False, True, False, False]
    assert [r.kept for r in quality_rules.apply_policy(rows, "v1").orderBy("doc_id").collect()] == [False, True, True, False]
    found = {r.rule: (r.failed, r.only, r.kept_without) for r in quality_rules.ablation(rows, "v2").collect()}
    assert found["few_words"] == (2, 1, 2) and found["symbols"] == (2, 0, 1)


@data
def test_language_held_out_accuracy(docs):
    found = language_id.predictions(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_toxicity_held_out_ranking(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.scores(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    good = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in rows if a.toxic for b in rows if not b.toxic]
    assert np.mean(good) > 0.98
    toxic = [r for r in rows if r.toxic]
    assert np.mean([r.predicted for r in toxic]) > 0.8 and np.mean([r.toxic for r in rows if r.predicted]) > 0.85


def test_isotonic_rises():
    random.seed(8)
    x = np.array([random.random() for _ in range(300)])
    y = (np.array([random.random() for _ in range(300)]) < x).astype(float)
    line = toxicity.isotonic(x, y)
    assert (np.diff(line[0]) >= 0).all() and (np.diff(line[1]) > 0).all() and abs(np.interp(0.5, *line) - 0.5) < 0.25


@data
def test_lines_against_all_pairs(docs):
    found = {r.doc_id: r.removed for r in line_dedup.removals(docs).collect()}
    places = defaultdict(list)
    for r in docs.collect():
        for no, line in enumerate(line_dedup.lines_of(r.text)):
            if line:
                places[line].append((r.doc_id, no))
    lines = list(places)
    sets = [frozenset(x[k : k + 8] for k in range(max(1, len(x) - 7))) for x in lines]
    groups, index = Groups(len(lines)), defaultdict(list)
    for i, s in enumerate(sets):
        common_ = defaultdict(int)
        for x in s:
            for j in index[x]:
                common_[j] += 1
            index[x].append(i)
        for j, n in common_.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                groups.join(i, j)
    members = defaultdict(list)
    for i, line in enumerate(lines):
        members[groups.find(i)] += places[line]
    expected = {r.doc_id: [] for r in docs.collect()}
    for group in members.values():
        for d, no in group:
            if (d, no) != min(group):
                expected[d].append(no)
    assert found == {d: sorted(v) for d, v in expected.items()}


@pytest.mark.parametrize(("block", "large", "loss"), [(8, 2048, 0.03), (8, 20, 0.03), (8, 20, 0.12), (4, 3, 0.3)])
def test_large_buckets_of_lines(spark, monkeypatch, block, large, loss):
    """Blocks of a bucket, compared pair by pair, and pivots with prefixes of what they leave over, find the same components."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(line_dedup, "LARGE", large)
    random.seed(9)
    base = [f"token{k}" for k in range(40)]
    rows = [(i, " ".join(w if random.random() > loss else f"other{random.randrange(9)}" for w in base)) for i in range(80)]
    found = {r.doc_id: r.removed for r in line_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [line_dedup.shingle_sets([t])[0] for _, t in rows]
    groups = Groups(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if line_dedup.alike(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                groups.join(i, j)
    assert found == {i: [] if groups.find(i) == i else [0] for i, _ in rows}


def test_pivots_and_prefixes_lose_no_link(spark, monkeypatch):
    """One bucket with all lines, so that links depend on pivots and prefixes alone."""
    monkeypatch.setattr(line_dedup, "BLOCK", 5)
    random.seed(10)
    base = [f"token{k}" for k in range(30)]
    lines = sorted({" ".join(w if random.random() > loss else f"x{random.randrange(6)}" for w in base) for loss in (0.02, 0.06, 0.1, 0.5) for _ in range(40)})
    keys = [line_dedup.line_key(x) for x in lines]
    members = spark.createDataFrame([(key, k) for key in (2, 4) for k in keys], "key long, line binary")
    bodies = spark.createDataFrame(list(zip(keys, lines, strict=True)), "line binary, body string")
    links, tasks = line_dedup.large_links(members, bodies)
    compared = tasks.join(bodies, "line").select("low", "key", "i", "j", "line", "body").repartition("low", "i", "j").sortWithinPartitions("low", "key", "i", "j", "line").mapInArrow(line_dedup._compared, "a binary, b binary")
    sets, groups, plain = line_dedup.shingle_sets(lines), Groups(len(lines)), Groups(len(lines))
    at = {k: i for i, k in enumerate(keys)}
    for a, b in links.union(compared).collect():
        assert line_dedup.alike(len(np.intersect1d(sets[at[bytes(a)]], sets[at[bytes(b)]])), len(sets[at[bytes(a)]]), len(sets[at[bytes(b)]]))
        groups.join(at[bytes(a)], at[bytes(b)])
    for i in range(len(lines)):
        for j in range(i):
            if line_dedup.alike(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                plain.join(i, j)
    assert [groups.find(i) for i in range(len(lines))] == [plain.find(i) for i in range(len(lines))]
    assert len({plain.find(i) for i in range(len(lines))}) > 20


def test_intervals(spark):
    changes = spark.sql("SELECT * FROM VALUES ('l', 'E.com', 'remove', 0), ('l', 'e.com', 'add', 1), ('l', 'e.com', 'add', 2), ('l', 'e.com', 'remove', 3), ('l', 'e.com', 'remove', 4), ('l', 'e.com', 'add', 4) AS t(list, entry, action, at)")
    assert sorted(map(tuple, url_filter.validity(changes).collect())) == [("l", "e.com", 1, 3), ("l", "e.com", 4, None)]


@data
def test_benchmark_against_brute_force(spark, docs):
    items = {r.item_id: decontaminate.words_of(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    windows = defaultdict(set)
    for i, words in items.items():
        for k in range(max(1, len(words) - 9)):
            windows[tuple(words[k : k + 10])].add(str(i))
    found = {r.doc_id: r for r in decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    for r in docs.collect():
        words, hit, listed = decontaminate.words_of(r.text.encode()), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if owners := windows.get(tuple(words[k : k + size])):
                    hit.update(range(k, k + size))
                    listed |= owners
        row = found[r.doc_id]
        assert (row.n_words, row.n_hit, row.items) == (len(words), len(hit), sorted(listed))
    sha = spark.range(1).select(decontaminate.digest(F.array(F.lit("1"), F.lit("10")))).first()[0]
    assert sha == hashlib.sha256(b"1,10").hexdigest()


@data
def test_pipeline_against_its_stages(spark, docs):
    import corpus_pipeline

    net = language_id.fit(docs)
    known = {r.doc_id for r in language_id.predictions(docs, net).where(f"lang_pred <> 'und' AND score >= {language_id.LEAST_SCORE}").collect()}
    kept = docs.where(F.col("doc_id").isin(list(known)))
    first = {r.component_id for r in simhash.near_duplicates(kept, corpus_pipeline.RADIUS).collect()}
    kept = kept.where(F.col("doc_id").isin(list(first)))
    clean = {r.doc_id for r in decontaminate.contamination(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit = 0").collect()}
    kept = kept.where(F.col("doc_id").isin(list(clean)))
    copies = {r.doc_id: r.copies for r in mixing.plan(kept).where("copies > 0").collect()}
    found = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        found[r.doc_id] += 1
    assert found == copies and [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmark", "mixture", "tokens"]
