"""Language identification by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes that overlap by the
widest filter less one, so no place of a filter is missed.  Bytes are embedded,
filters of several widths run over a window, the largest answer of each filter
is kept, and softmax weighs the languages.  A text's probabilities are the mean
over its windows, each weighted by its bytes; whole texts are read, in batches
of windows of one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steadfold.llm.common import in_slices, materialize
from steadfold.sources.names import unused

UNKNOWN = "und"
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
STEP = WINDOW - max(WIDTHS) + 1
CHUNK = 128
#: Bounds of the sample that the network is fitted on: documents in all, of each language, and windows of each document.
#: Every language is learned; the more there are, the fewer documents each has, one at least.
SAMPLE, DOCUMENTS, WINDOWS = 40_000, 400, 6
#: A filter keeps a document whose language has this probability at least.
LEAST_SCORE = 0.4


@dataclass
class Network:
    labels: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    shift: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.dense, self.shift]

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Filter maxima, their places, and the embedded patches, of windows as rows of bytes."""
        embedded = self.embedding[windows]
        n, length, size = embedded.shape
        width = max(WIDTHS)
        patches = np.lib.stride_tricks.sliding_window_view(embedded.reshape(n, -1), width * size, axis=1)[:, ::size]
        answers = (patches.reshape(-1, width * size) @ self.filters).reshape(n, length - width + 1, -1)
        return answers.max(axis=1) + self.bias, answers, patches

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        top = np.maximum(self.pooled(windows)[0], 0)
        return _softmax(top @ self.dense + self.shift)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _padded(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(WINDOW, b"\0") for p in parts), np.uint8).reshape(-1, WINDOW)


def open_weights() -> np.ndarray:
    """A narrow filter is a wide one whose further weights stay zero."""
    return np.repeat(np.arange(max(WIDTHS))[:, None] < np.repeat(WIDTHS, FILTERS)[None, :], EMBEDDING, axis=0)


def gradients(net: Network, windows: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted mean cross entropy, by all parameters in their order."""
    n, width = len(windows), max(WIDTHS)
    maxima, answers, patches = net.pooled(windows)
    top = np.maximum(maxima, 0)
    wrong = _softmax(top @ net.dense + net.shift)
    wrong[np.arange(n), truth] -= 1
    wrong *= weight[:, None] / n
    back = (wrong @ net.dense.T) * (maxima > 0)
    places = answers.argmax(axis=1)
    used = patches[np.arange(n)[:, None], places]  # window, filter, patch
    d_filters = np.einsum("bf,bfk->kf", back, used) * open_weights()
    d_patch = (back[:, :, None] * net.filters.T[None]).reshape(n, -1, width, EMBEDDING)
    at_bytes = windows[np.arange(n)[:, None, None], places[:, :, None] + np.arange(width)]
    d_embedding = np.zeros_like(net.embedding)
    np.add.at(d_embedding, at_bytes, d_patch)
    return [d_embedding, d_filters, back.sum(0), top.T @ wrong, wrong.sum(0)]


def train(parts: list[bytes], labels: list[str], epochs: int = 10, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network | None:
    """Fit the network to windows by Adam; the same windows in the same order give the same network."""
    if not parts:
        return None
    random, names = np.random.default_rng(seed), sorted(set(labels))
    truth = np.array([names.index(x) for x in labels])
    every, width, n_filters = _padded(parts), max(WIDTHS), FILTERS * len(WIDTHS)
    normal = lambda *shape, by: random.normal(0, by, shape).astype(np.float32)
    net = Network(names, normal(256, EMBEDDING, by=0.5), normal(width * EMBEDDING, n_filters, by=0.2), np.zeros(n_filters, np.float32), normal(n_filters, len(names), by=0.2), np.zeros(len(names), np.float32))
    net.filters *= open_weights()
    params = net.params()
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = (len(truth) / len(names) / np.bincount(truth, minlength=len(names)))[truth].astype(np.float32)
    for epoch in range(epochs):
        order = random.permutation(len(truth))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            windows = every[rows].copy()
            for i in np.flatnonzero(random.random(len(rows)) < 0.3):  # short texts
                windows[i, random.integers(8, WINDOW) :] = 0
            t += 1
            step = rate * (1 - epoch / epochs)
            for p, g, m, v in zip(params, gradients(net, windows, truth[rows], weight[rows]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the doc_id as text leaves 2 modulo 4; null ids aren't among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


#: Draws are whole numbers below this.
_DRAWS = 1 << 53


def sample(docs: DataFrame) -> DataFrame:
    """lang, draw and parts (windows of bytes) of the rows that are learned from; of every language one at least.

    Rows that are alike in doc_id and text share their draw, so shares are taken
    from how many different draws a language has, about, and never leave out
    its smallest one.  What the shares let through is cut exactly, language by
    language.
    """
    known = docs.where(F.col("text").isNotNull() & (F.length("text") > 0) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = known.select("lang", "doc_id", "text", F.pmod(F.xxhash64("doc_id", F.lit("sample"), "text"), F.lit(_DRAWS)).alias("draw"))
    counts = drawn.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n"), F.min("draw").alias("least"))
    counts = materialize(counts, "languages")
    most = max(1, min(DOCUMENTS, SAMPLE // max(1, counts.count())))
    # Languages of few rows take all of them; of the others about half as many again as are needed, twelve at least.
    bound = F.greatest("least", (F.least(F.lit(1.0), F.lit(max(1.5 * most, 12.0)) / F.col("n")) * _DRAWS).cast("long"))
    body = F.col("text").cast("binary")
    places = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.substring(body, (F.pmod(F.xxhash64("doc_id", k), F.greatest(F.lit(1), F.octet_length("text") - WINDOW + 1).cast("long")) + 1).cast("int"), F.lit(WINDOW)))
    chosen = drawn.join(counts.select(F.col("lang").alias("of"), bound.alias("bound")), F.col("lang") == F.col("of")).where("draw <= bound")
    once = chosen.select("lang", "draw", F.when(F.octet_length("text") <= WINDOW, F.array(body)).otherwise(places).alias("parts")).groupBy("lang", "draw").agg(F.min("parts").alias("parts"))
    return once.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("nth") <= most).select("lang", "draw", "parts")


def fit(docs: DataFrame) -> Network | None:
    """The network of ``docs`` (doc_id, text, lang), or None where there is nothing to learn from.

    Learns from rows with a text and a language that aren't held out, of every
    language at most DOCUMENTS, and so many that all are about SAMPLE, chosen
    by a hash of the doc_id and the text, repeated rows once, and from WINDOWS
    windows of each at places drawn by a hash.  However many rows are alike, no
    language is left out.  Windows are cut on the executors, so long texts
    don't come here.
    """
    rows = sorted((r.lang, r.draw, [bytes(p) for p in r.parts]) for r in sample(docs).collect())
    return train([p for _, _, parts in rows for p in parts], [lang for lang, _, parts in rows for _ in parts])


def predict(net: Network | None, texts: list[bytes | None], letters: list[bool]) -> tuple[list[str], list[float]]:
    """The language and its probability of each whole text; UNKNOWN and 0 without a letter or a network."""
    known = [i for i, ok in enumerate(letters) if ok and net is not None]
    sums, totals = np.zeros((len(texts), len(net.labels) if net else 1)), np.zeros(len(texts))
    owners: list[int] = []
    parts: list[bytes] = []

    def flush() -> None:
        found = net.probabilities(_padded(parts))
        sizes = np.array([len(p) for p in parts])
        np.add.at(sums, owners, found * sizes[:, None])
        np.add.at(totals, owners, sizes)
        owners.clear()
        parts.clear()

    for i in known:
        text = texts[i]
        for at in range(0, max(1, len(text) - WINDOW + STEP), STEP):
            parts.append(text[at : at + WINDOW])
            owners.append(i)
            if len(parts) == CHUNK:
                flush()
    if parts:
        flush()
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    for i in known:
        best = int(sums[i].argmax())
        langs[i], scores[i] = net.labels[best], min(1.0, float(sums[i, best] / totals[i]))
    return langs, scores


def has_letter(text: Column) -> Column:
    return F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))


def predictions(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; nothing but the text is used to predict.

    A null text, and one without a letter, is ``und`` with score 0.  Repeated
    rows each get their row; a null doc_id is kept and isn't held out; an empty
    table gives an empty result.  A narrow map, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            langs, scores = predict(net, batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"), has_letter(F.col("text")).alias("letter"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: Network | None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, as they are, whose language is known with a probability of ``least`` or more.

    Null texts, those without a letter, and all of them where nothing could be
    learned, go.  Repeated rows stay or go together; an empty table gives an
    empty result.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            langs, scores = predict(net, batch.column(len(names)).cast(pa.binary()).to_pylist(), batch.column(len(names) + 1).to_pylist())
            kept = batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[: len(names)], names)

    body, letter = unused(names, "body", "letter")
    return docs.select(*names, F.col("text").cast("string").alias(body), has_letter(F.col("text")).alias(letter)).mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predictions(docs, fit(docs))
