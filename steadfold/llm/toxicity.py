"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities of a fixed lexicon and of one mined from
labelled texts, how near second-person words stand to lexicon words, capitals,
punctuation and obfuscation rates.  One part of the labelled sample is mined
for the lexicon; trees are fitted on the other part, so that a mined word isn't
trusted for the texts that it was mined from; scores of trees that haven't seen
a row calibrate the final ones by isotonic regression.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfold.llm.common import in_slices, materialize

#: Bounds of the sample: labelled rows that are learned from, and entries of the mined lexicon.
ROWS, ENTRIES = 24_000, 400
#: An entry is a word or a beginning of words of these lengths, with a star.
PREFIXES = (5, 6, 7)
TREES, DEPTH, BINS, RATE = 80, 3, 32, 0.15
NEAR = 4

#: Insults in English, and second-person words in several languages.
LEXICON = frozenset("asshole bastard bitch clown coward crap cretin degenerate disgusting dumb filth fool freak garbage hate idiot imbecile jerk kill loser lunatic moron pathetic pig psycho scum shit slut stupid trash ugly vermin whore worthless".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros".split())
FEATURES = ("base", "mined", "best", "second", "near_base", "near_mined", "capitals", "exclaims", "questions", "punctuation", "leet", "spaced", "masked", "length", "distinct", "hidden")

_WORD = re.compile(r"[^\W_]+")
#: A run of letters and signs with a sign in front of a letter.  It starts at the beginning of a run only and never goes back, so long runs take no longer than others.
_LEET_WORD = re.compile(r"(?<![A-Za-z0-9@$!*])[A-Za-z]*+[0-9@$!*]++[A-Za-z][A-Za-z0-9@$!*]*+")
_SPACED = re.compile(r"\b(?:[A-Za-z][ .\-*]){3,}[A-Za-z]\b")
#: Characters that stand for letters.
_LEET = str.maketrans("013457@$!*", "oieastasi*")


@dataclass
class Lexicon(dict):
    """A word's weight: 2 for the fixed lexicon, up to 1 for the mined one, else 0.  Remembers a bounded number of words."""

    entries: dict[str, float] = field(default_factory=dict)
    words: dict[int, list[str]] | None = None

    def __missing__(self, word: str) -> float:
        best = 2.0 if word in LEXICON else max((self.entries.get(k, 0.0) for k in (word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n))), default=0.0)
        if len(self) >= 200_000:
            self.clear()
        self[word] = best
        return best


    def masked(self, run: str) -> bool:
        """Whether a run of letters and stars, two letters of them at least, fits a word of the lexicon, a star for a letter."""
        if self.words is None:
            self.words = {}
            for word in (*LEXICON, *(k for k in self.entries if "*" not in k)):
                self.words.setdefault(len(word), []).append(word)
        return sum(c != "*" for c in run) > 1 and any(all(a in ("*", b) for a, b in zip(run, word, strict=True)) for word in self.words.get(len(run), ()))

    def unmasked(self, run: str) -> bool:
        """Whether a run of letters and signs stands for a word of the lexicon, with or without the marks at its end."""
        for plain in {run, run.rstrip("!*0123456789"), run.rstrip("!")}:
            word = plain.lower().translate(_LEET)
            if "*" in word:
                if self.masked(word):
                    return True
            elif self[word] > 0:
                return True
        return False


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The features, in the order of FEATURES, of a whole text; of a null or empty one they are all zero."""
    text = text or ""
    words = _WORD.findall(text.lower())
    weights = list(map(lexicon.__getitem__, words))
    hits = [i for i, w in enumerate(weights) if w]
    base = sum(weights[i] == 2 for i in hits)
    near = [0, 0]
    for i in hits:
        if not SECOND.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]):
            near[weights[i] < 2] += 1
    n = max(1, len(words))
    body = text.encode()
    count = lambda chars: len(body) - len(body.translate(None, chars))
    upper, letters = count(bytes(range(65, 91))), count(bytes(range(65, 91)) + bytes(range(97, 123)))
    leet = _LEET_WORD.findall(text)
    spaced = _SPACED.findall(text)
    hidden = sum(map(lexicon.unmasked, leet)) + sum(lexicon[re.sub(r"[^a-z]", "", w.lower())] > 0 for w in spaced)
    distinct = len({words[i] for i in hits})
    return [100 * base / n, 100 * (len(hits) - base) / n, max((weights[i] for i in hits), default=0.0), 100 * sum(w in SECOND for w in words) / n, 100 * near[0] / n, 100 * near[1] / n, upper / max(1, letters), 100 * text.count("!") / n, 100 * text.count("?") / n, 100 * count(b".,;:-\"'()") / n, 100 * len(leet) / n, 100 * len(spaced) / n, 100 * text.count("*") / n, float(np.log1p(len(words))), float(distinct), float(hidden)]


def keys(text: str | None) -> set[str]:
    words = {w for w in _WORD.findall((text or "").lower()) if len(w) > 2}
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}


@dataclass
class Trees:
    """Boosted trees of one depth over binned features, for logistic loss."""

    edges: list[np.ndarray]
    start: float
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.binned(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaves in self.splits:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            out += leaves[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Fit by histograms; no row or one class gives trees that only know the base rate."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    trees = Trees([np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])], float(np.log(rate / (1 - rate))))
    if not 0 < y.sum() < len(y):
        return trees
    bins, margin, n_features = trees.binned(x), np.full(len(y), trees.start), x.shape[1]
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            gain = np.full((width, n_features, BINS), -1.0)
            for j in range(n_features):
                at = (node - first) * BINS + bins[:, j]
                g = np.bincount(at, grad, width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(at, hess, width * BINS).reshape(width, BINS).cumsum(axis=1)
                left, right = g**2 / (h + 1), (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1)
                gain[:, j] = np.where((h > 0.5) & (h[:, -1:] - h > 0.5), left + right - g[:, -1:] ** 2 / (h[:, -1:] + 1), -1)
            best = gain.reshape(width, -1).argmax(axis=1)
            good = gain.reshape(width, -1).max(axis=1) > 1e-6
            feature[first : first + width], cut[first : first + width] = best // BINS, np.where(good, best % BINS, BINS)
            node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        leaves = RATE * np.bincount(leaf, grad, 2**DEPTH) / (np.bincount(leaf, hess, 2**DEPTH) + 1)
        trees.splits.append((feature, cut, leaves))
        margin += leaves[leaf]
    return trees


def isotonic(scores: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points of a rising line from scores to rates."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []
    for s, t in zip(scores[order].tolist(), truth[order].tolist(), strict=True):
        blocks.append([t, 1, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, n, s = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + n, (blocks[-1][2] * blocks[-1][1] + s * n) / (blocks[-1][1] + n)]
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    entries: dict[str, float]
    trees: Trees
    line: tuple[np.ndarray, np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; where calibration is flat, the trees' own order decides."""
        margin = self.trees.margins(x)
        raw = 1 / (1 + np.exp(-margin))
        return np.clip(0.998 * (np.interp(margin, *self.line) if len(self.line[0]) else raw) + 0.002 * raw, 0, 1)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the doc_id as text leaves 0 modulo 5; null ids aren't among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic and draw of labelled ids that aren't held out, at most ROWS of them, those of the lowest hashes.

    A label is of an id, so of the rows that share it the one with the smallest
    key of its text is learned from, and the sample has one row an id however
    often an id repeats.  The chosen labels are as few as ROWS, so they go to
    the texts, which don't move.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 40)).alias("draw")
    chosen = materialize(marked.select("doc_id", F.col("toxic").cast("int").alias("toxic"), draw).orderBy("draw", "doc_id").limit(ROWS), "labels")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "toxic", "draw").agg(F.min_by("text", F.struct(F.isnull("text"), F.xxhash64("text"))).alias("text"))
    return materialize(one.select("text", "toxic", "draw"), "sample")


def mine(rows: DataFrame) -> dict[str, float]:
    """Words and beginnings that mark toxic texts, with their share of them; at most ENTRIES."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[toxic].update(keys(text))
            names = list(found[1])  # what no toxic text has can't mark one
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[1][k] for k in names], pa.int64()), pa.array([found[0][k] for k in names], pa.int64())], ["key", "a", "b"])

    def against(entries: list[str]):
        wanted = frozenset(entries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: Counter = Counter()
                for text in batch.column(0).to_pylist():
                    found.update(wanted.intersection(keys(text)))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["key", "b"])

        return run

    toxic = rows.where("toxic = 1")
    n = toxic.count()
    least = max(3, n // 300)
    often = toxic.select("text", "toxic").mapInArrow(counted, "key string, a long, b long").groupBy("key").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    often = {r.key: r.a for r in often.orderBy(F.desc("a"), "key").limit(50 * ENTRIES).collect()}
    clean = rows.where("toxic = 0").select("text").mapInArrow(against(list(often)), "key string, b long").groupBy("key").agg(F.sum("b").alias("b"))
    others = {r.key: r.b for r in clean.collect()}
    rates = {k: a / (a + others.get(k, 0) + 0.5) for k, a in often.items()}
    chosen = sorted((k for k in rates if rates[k] >= 0.6), key=lambda k: (-rates[k] * np.log(often[k]), k))[:ENTRIES]
    return {k: min(1.0, float(rates[k])) for k in chosen}


def measured(rows: DataFrame, entries: dict[str, float], extra: list[str], schema: str) -> DataFrame:
    """``extra`` columns of ``rows``, and the features of ``text``, as an array of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries=entries)
        for batch in in_slices(batches):
            found = [features(t, lexicon) for t in batch.column(len(extra)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(extra)], pa.array(found, pa.list_(pa.float64()))], [*extra, "x"])

    return rows.select(*extra, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{schema}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from a bounded sample of labelled rows; without any, every score is the base rate of one half."""
    rows = sample(docs, labels)
    entries = mine(rows.where("draw % 2 = 0"))
    found = measured(rows.where("draw % 2 = 1"), entries, ["toxic", "draw"], "toxic int, draw long").collect()
    found.sort(key=lambda r: (r.draw, r.toxic, r.x))
    x = np.array([r.x for r in found]).reshape(-1, len(FEATURES))
    y = np.array([r.toxic for r in found], float)
    margins, folds = np.zeros(len(y)), np.arange(len(y)) % 4
    for k in range(4):
        margins[folds == k] = boost(x[folds != k], y[folds != k]).margins(x[folds == k])
    return Model(entries, boost(x, y), isotonic(margins, y))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its text alone.

    Null and empty texts have zero features and get the score of those.
    Repeated rows each get their row; a null doc_id is kept; an empty table
    gives an empty result.  A narrow map, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries=model.entries)
        for batch in in_slices(batches):
            x = np.array([features(t, lexicon) for t in batch.column(2).to_pylist()]).reshape(-1, len(FEATURES))
            found = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
