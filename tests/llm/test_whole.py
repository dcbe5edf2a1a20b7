"""The whole job, where a shorter one would pass the other tests."""

import random

import duckdb
import numpy as np

from steadfold.llm import language_id, license_scan, line_dedup, quality_rules, token_files, toxicity, url_filter


def test_texts_with_several_licences(spark):
    mit, bsd, gpl, apache = (next(t[2] for t in license_scan.TEMPLATES if t[0] == label and not t[1]) for label in ("mit", "bsd", "gpl", "apache"))
    texts = [mit] * 200 + [f"{mit} filler {bsd}", f"{mit} filler {gpl} filler {apache}"]
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i].labels for i in (0, 200, 201)] == ["mit", "bsd,mit", "apache,gpl,mit"]
    assert all((3, 0, 1.0) in [(s.template, s.start, s.share) for s in found[i].spans] for i in (0, 200, 201))
    every = "\n".join([t[2] for t in license_scan.TEMPLATES] + [t[1] for t in license_scan.TEXTS])
    odd = ["mit \u212aicense", "MIT-License", every, every.upper(), "mit " * 1000 + "license", "of this software without specific prior written permission"]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")).collect()
    one, dashed, whole, upper, many, part = sorted(rows, key=lambda r: r.doc_id)
    assert (one.n_words, one.base_labels, dashed.base_labels) == (2, "", "mit")  # the Kelvin sign isn't a k
    assert whole.labels == upper.labels == ",".join(sorted({t[0] for t in (*license_scan.TEMPLATES, *license_scan.TEXTS)}))
    assert {s.template for s in whole.spans} >= set(range(len(license_scan.INDEX))) and whole.score == 1
    assert (many.n_base, many.first_word, part.labels) == (1, 999, "")


def test_special_tokens_have_their_ids():
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(token_files.default_tokenizer())
    mark = "<|endoftext|>"
    texts = [mark, f"end {mark} next", f"a{mark}b", f"a {mark}", f"{mark} a", f"a  {mark}  {mark}\n{mark}b", f"x\n{mark}\ny {mark}.", f"été{mark} {mark}{mark}", f"a\n {mark}\n\n b", "<|endoftext|", "< |endoftext|>"]
    random.seed(4)
    texts += ["".join(random.choice([mark, "a", "bc", " ", " ", ".", "\n", "\t", "é", "'s"]) for _ in range(30)) for _ in range(300)]
    for text, ids in zip(texts, token_files.encode(texts, token_files.default_tokenizer()), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == loaded.encode(text, add_special_tokens=False).ids, text


def test_short_lines_with_one_other_character(spark):
    random.seed(7)
    lines = []
    for size in (39, 45, 50, 60, 70, 78, 99):
        for _ in range(8):
            line = "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
            at = random.randrange(size)
            lines += [line, line[:at] + "9" + line[at + 1 :]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {r.doc_id: r.removed for r in line_dedup.removals(docs).collect()}
    assert found == {i: [0] * (i % 2) for i in range(len(lines))}


def test_deep_entries(spark):
    host = ".".join("abcdefghij")
    captures = spark.sql(f"SELECT * FROM VALUES (1L, 'http://example.com/a/b/c/d/e/f', timestamp '2024-05-01'), (2L, 'http://x.{host}/y', timestamp '2024-05-01'), (3L, 'http://example.com/a/b/c', timestamp '2024-05-01'), (4L, 'http://e.org/fr', timestamp '2024-05-01'), (5L, 'http://e.org//fr', timestamp '2024-05-01'), (6L, 'http://e.org/fr//x', timestamp '2024-05-01'), (7L, 'http://e.org/fr2', timestamp '2024-05-01') AS t(page_id, url, fetched_at)")
    changes = spark.sql(f"SELECT * FROM VALUES ('l', 'example.com/a/b/c/d/e', 'add', timestamp '2024-01-01'), ('m', '{host}.', 'add', timestamp '2024-01-01'), ('n', 'E.org/fr/', 'add', timestamp '2024-01-01') AS t(list, entry, action, at)")
    found = {r.page_id: (r.lists, r.entry) for r in url_filter.judge(captures, changes).collect()}
    assert found == {1: ("l", "example.com/a/b/c/d/e"), 2: ("m", host), 3: ("", None), 4: ("n", "e.org/fr"), 5: ("", None), 6: ("n", "e.org/fr"), 7: ("", None)}


def test_odd_urls_against_sql(spark, tmp_path):
    """URLs that the sample hasn't, by the registered query and its SQL."""
    hosts = ["a.b.c.d.e.f.g.h.example.org", "x.a.b.c.d.e.f.g.h.example.org", "CDN.example.com.", "example.org", "m.example.org:8080", "u@adult.example.org", "com", "ththre.example.com", ""]
    paths = ["", "/", "/a/b/c/d", "/a/b/c/d/e", "/a/b/c/", "//a/b/c/d", "/es", "/es/", "/es//x?q#f", "/fr", "/fr2", "//fr", "/FR"]
    urls = [f"{scheme}{h}{p}" for scheme in ("http://", "HTTPS://") for h in hosts for p in paths] + [None, "", "no url", "http://"]
    spark.createDataFrame([(i, u, None) for i, u in enumerate(urls * 2)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    expected = con.sql(url_filter.SQL)
    found = url_filter.op3_url_filter(spark, str(tmp_path)).select(*expected.columns).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected.fetchall())) and sum(r.n_entries for r in found) > 10


def test_rows_of_one_id_are_many_shards(spark, tmp_path):
    docs = spark.range(20_000).selectExpr("7L AS doc_id", "concat('text number ', id) AS text").unionByName(spark.range(3).selectExpr("id AS doc_id", "cast(null AS string) AS text"))
    folder, manifest = token_files.write_tokens(docs, f"file://{tmp_path}/tokens", shards=6)
    sizes = [r.n_docs for r in manifest.collect()]
    assert len(sizes) > 3 and max(sizes) < 10_000 and sum(sizes) == 20_003
    found = token_files.read_digests(folder, manifest).orderBy("start").collect()
    assert [r.doc_id for r in found] == [0, 1, 2] + [7] * 20_000
    assert all(a.start + a.n_tokens == b.start for a, b in zip(found, found[1:], strict=False))


def test_repeated_words_against_tuples():
    def plain(words):
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        return len({i for k, w in enumerate(windows) if windows.count(w) > 1 for i in range(k, k + 8)})

    random.seed(3)
    for size in (0, 1, 7, 8, 9, 16, 40, 120):
        for kinds in (1, 2, 3, 50):
            for _ in range(8):
                words = [b"w%d" % random.randrange(kinds) for _ in range(size)]
                words += words[: random.randrange(1 + len(words))]
                assert quality_rules.repeated_words(words) == plain(words)
    assert quality_rules.repeated_words([b"w%d" % (k % 500_000) for k in range(1_000_000)]) == 1_000_000


def test_hidden_words():
    lexicon = toxicity.Lexicon(entries={"vilify": 0.9, "nast*": 0.8})
    at = toxicity.FEATURES.index("hidden")
    hidden = lambda text: toxicity.features(text, lexicon)[at]
    assert [hidden(t) for t in ("m0r0n", "a55h0le", "b@st@rd", "1diot", "@sshole!", "$tup1d", "s**t", "f*ol", "v!l!fy", "i d i o t")] == [1] * 10
    assert [hidden(t) for t in ("", "covid19", "hello!", "2nd place", "**bold**", "a*b", "5 * 6", "x" * 100_000 + "0" * 100_000, "f**t")] == [0] * 9


def test_labels_of_repeated_ids_bring_one_row(spark):
    docs = spark.range(3000).selectExpr("id % 3 AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, toxic int")
    held = {r.doc_id for r in labels.where(toxicity.held_out(labels["doc_id"])).collect()}
    assert toxicity.sample(docs, labels).count() == 3 - len(held)


def test_trees_against_a_plain_search():
    """The first tree, level by level, against a loop over all rows and cuts."""
    random_ = np.random.default_rng(5)
    x = random_.normal(0, 1, (300, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(float)
    trees = toxicity.boost(x, y)
    bins, p = trees.binned(x), 1 / (1 + np.exp(-trees.start))
    grad, hess = y - p, np.full(len(y), p * (1 - p))
    feature, cut, leaves = trees.splits[0]
    node = np.zeros(len(y), int)
    for _ in range(toxicity.DEPTH):
        for k in np.unique(node):
            rows, best = np.flatnonzero(node == k), (1e-6, None)
            whole = grad[rows].sum() ** 2 / (hess[rows].sum() + 1)
            for j in range(3):
                for c in range(toxicity.BINS):
                    left, right = rows[bins[rows, j] <= c], rows[bins[rows, j] > c]
                    if hess[left].sum() > 0.5 and hess[right].sum() > 0.5:
                        gain = grad[left].sum() ** 2 / (hess[left].sum() + 1) + grad[right].sum() ** 2 / (hess[right].sum() + 1) - whole
                        if gain > best[0] + 1e-9:
                            best = (gain, (j, c))
            if best[1]:
                assert (feature[k], cut[k]) == best[1]
        node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > cut[node])
    for k in np.unique(node):
        rows = node == k
        assert leaves[k - 7] == np.float64(toxicity.RATE * grad[rows].sum() / (hess[rows].sum() + 1)) or abs(leaves[k - 7] - toxicity.RATE * grad[rows].sum() / (hess[rows].sum() + 1)) < 1e-9
    assert ((trees.margins(x) > 0) == (y > 0.5)).mean() > 0.95


def test_isotonic_is_the_best_rising_line():
    """Against the min-max formula: the fit at i is the largest of least means over intervals that hold i."""
    random_ = np.random.default_rng(6)
    score, truth = np.sort(random_.random(40)), (random_.random(40) < 0.5).astype(float)
    at, rate = toxicity.isotonic(score, truth)
    plain = [max(min(truth[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    blocks = sorted({round(v, 9) for v in plain})
    assert sorted({round(v, 9) for v in rate}) == blocks and (np.diff(rate) > 0).all() and (np.diff(at) > 0).all()


def test_network_against_loops():
    """Probabilities by loops over filters and places; gradients by differences."""
    random_ = np.random.default_rng(1)
    parts = [bytes(random_.integers(97, 123, 60).astype(np.uint8)) for _ in range(12)]
    net = language_id.train(parts, ["a", "b", "c"] * 4, epochs=1)
    windows = language_id._padded(parts)
    for row, found in zip(windows, net.probabilities(windows), strict=True):
        top = []
        for f in range(net.filters.shape[1]):
            w = net.filters[:, f].reshape(-1, language_id.EMBEDDING)
            top.append(max(0.0, net.bias[f] + max(sum(float(net.embedding[row[i + k]] @ w[k]) for k in range(len(w))) for i in range(language_id.WINDOW - len(w) + 1))))
        z = np.array(top) @ net.dense + net.shift
        assert np.allclose(found, np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-4)
    for f, width in enumerate(np.repeat(language_id.WIDTHS, language_id.FILTERS)):
        assert not net.filters[width * language_id.EMBEDDING :, f].any()
    truth, weight = np.array([0, 1, 2] * 4), np.ones(12, np.float32)
    wide = language_id.Network(net.labels, *(p.astype(np.float64) for p in (net.embedding, net.filters, net.bias, net.dense, net.shift)))
    loss = lambda: float(-np.log(wide.probabilities(windows)[np.arange(12), truth]).mean())
    grads = language_id.gradients(wide, windows, truth, weight)
    for param, grad in zip(wide.params(), grads, strict=True):
        for at in random_.permutation(np.flatnonzero(np.abs(grad).ravel() > 1e-6))[:6]:
            before = param.flat[at]
            param.flat[at] = before + 1e-5
            above = loss()
            param.flat[at] = before - 1e-5
            below = loss()
            param.flat[at] = before
            assert abs((above - below) / 2e-5 - grad.flat[at]) < 1e-3 * max(1, abs(grad.flat[at]))


def test_as_many_languages_as_there_are(spark):
    random.seed(2)
    rows = []
    for k in range(250):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(6)]
        rows += [(1000 * k + n, "".join(random.choice(letters) for _ in range(30)), f"l{k}") for n in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = {r.lang for r in docs.where(~language_id.held_out(docs["doc_id"])).collect()}
    assert set(language_id.fit(docs).labels) == known and len(known) > 240
