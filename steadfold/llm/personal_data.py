"""Personal data by patterns and by a linear-chain conditional random field over word shapes.

Patterns find e-mail and IP addresses, card and telephone numbers in their plain
notation.  The random field finds them in others: spelled out, spaced or
bracketed addresses, numbers with other separators or without a country code.
It is trained on a small labelled table and decoded by Viterbi's algorithm, many
pieces of text at a time.

A token is a run of letters, a run of digits, or one other sign.  Only tokens
within REACH of a digit, an at sign or a word such as "at" or "dot", on the same
line, can be part of a span; all others are O by definition of the model, in
training and in decoding.  So a text falls into pieces that don't depend on each
other, and decoding these is decoding the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfold.llm.common import in_slices
from steadfold.llm.personal_examples import examples
from steadfold.sources.names import unused

KINDS = ("email", "ip", "card", "phone")
#: Labels: 0 is outside, 1 + 2k begins kind k and 2 + 2k goes on with it.
LABELS = 1 + 2 * len(KINDS)
REACH = 8
#: Words that stand for signs, in several languages.
SPELLED = ("at", "dot", "arroba", "punto", "arobase", "point", "punkt")
#: Rows that the field is fitted on, at most, and characters that are decoded at once, if lines allow it.
ROWS, CHARS = 4000, 1 << 20

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits' check sum is right."""
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _is_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From one at sign to the next, so that nothing is read more often than twice."""
    low, at = 0, text.find("@")
    while at >= 0:
        run = _LOCAL.match(text[low:at][::-1]).end()
        found = _DOMAIN.match(text, at + 1) if run else None
        if found:
            yield at - run, found.end()
        low = found.end() if found else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the plain patterns, leftmost and without overlaps in a kind, by kind and start; in linear time."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_is_byte, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(m.group().count, "0123456789")) <= 15]
    return found


# Tokens and features, of many texts at once.

_SPACE, _DIGIT, _LETTER, _SIGN = range(4)
_GROUPS = np.full(128, _SIGN, np.uint8)
_GROUPS[[9, 10, 11, 12, 13, 32]] = _SPACE
_GROUPS[48:58] = _DIGIT
_GROUPS[65:91] = _GROUPS[97:123] = _LETTER
_EDGE, _LARGE, _OTHER = 1, 125, 126
#: Offsets of the neighbours whose shapes are taken together, and of those whose words are.
_SHAPES = ((), (-3,), (-2,), (-1,), (0,), (1,), (2,), (3,), (-1, 0), (0, 1), (-2, -1), (1, 2), (-2, -1, 0), (-1, 0, 1), (0, 1, 2), (0, 1, 2, 3), (-3, -2, -1, 0))
_WORDS = (-2, -1, 0, 1, 2)
_LONGEST = 12


def _hash(letters: Iterable[np.ndarray | int]) -> np.ndarray | int:
    """A 56-bit number of up to _LONGEST lower-case code points, zeros behind the last."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in letters:
            h = h * np.uint64(1000003) + np.asarray(c, np.uint64) + np.uint64(1)
    return h & np.uint64((1 << 56) - 1)


def _hash_of(word: str) -> int:
    return int(_hash([ord(c) for c in word[:_LONGEST].ljust(_LONGEST, "\0")]))


_SPELLED = np.array([_hash_of(w) for w in SPELLED], np.uint64)


@dataclass
class Pieces:
    """Tokens of some texts that may be part of a span: start, end, and where each piece begins (and the last ends)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    features: list[np.ndarray]


def pieces(text: str) -> Pieces:
    """The pieces of a text, with the codes of their tokens' features, one array for each template."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    group = np.where(codes < 128, _GROUPS[np.minimum(codes, 127)], np.where((codes == 0xA0) | (codes == 0x3000), _SPACE, _LETTER)).astype(np.uint8)
    border = np.ones(len(codes) + 1, bool)
    border[1:-1] = (group[1:] != group[:-1]) | (group[1:] == _SIGN)
    at = np.flatnonzero(border)
    start, end = at[:-1], at[1:]
    full = group[start] != _SPACE
    start, end = start[full], end[full]
    kind, line = group[start], np.searchsorted(np.flatnonzero(codes == 10), start)

    trigger = (kind == _DIGIT) | (codes[start] == 64)
    short = np.flatnonzero((kind == _LETTER) & (end - start >= 2) & (end - start <= 7) & np.isin(codes[start] | 32, [ord(w[0]) for w in SPELLED]))
    trigger[short[np.isin(_word_hashes(codes, start[short], end[short]), _SPELLED)]] = True
    marks, every = np.flatnonzero(trigger), np.arange(len(start))

    def near(reach: int) -> np.ndarray:
        after = np.searchsorted(marks, every)
        found = np.zeros(len(start), bool)
        for k, some in ((after - 1, after > 0), (after, after < len(marks))):
            i = every[some]
            m = marks[k[some]]
            found[i] |= (np.abs(m - i) <= reach) & (line[m] == line[i])
        return np.flatnonzero(found)

    if not len(marks):
        none = np.empty(0, np.int64)
        return Pieces(none, none, np.zeros(1, np.int64), [none] * (len(_SHAPES) + len(_WORDS)))
    known, free = near(REACH + 3), near(REACH)
    shape, words = np.full(len(start) + 6, _EDGE, np.int64), np.zeros(len(start) + 6, np.uint64)
    shape[known + 3] = _shapes(codes, group, start[known], end[known])
    words[known + 3] = _word_hashes(codes, start[known], end[known])
    lines = np.full(len(start) + 6, -1)
    lines[3:-3] = line
    own = {k: lines[free + 3 + k] == line[free] for k in range(-3, 4)}
    shapes = {k: np.where(own[k], shape[free + 3 + k], 2 * _EDGE) for k in range(-3, 4)}
    features = []
    for t, offsets in enumerate(_SHAPES):
        code = np.full(len(free), (t + 1) << 56, np.int64)
        for j, k in enumerate(offsets):
            code += shapes[k] << (8 * j)
        features.append(code)
    for t, k in enumerate(_WORDS):
        features.append(((len(_SHAPES) + t + 1) << 56) + np.where(own[k], words[free + 3 + k], 0).astype(np.int64))
    first = np.flatnonzero(np.r_[True, (np.diff(free) > 1) | (line[free[1:]] != line[free[:-1]]), True])
    return Pieces(start[free], end[free], first, features)


def _word_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    def letters() -> Iterator[np.ndarray]:
        for j in range(_LONGEST):
            c = codes[np.minimum(start + j, len(codes) - 1)]
            yield np.where(start + j < end, np.where((c >= 65) & (c <= 90), c + 32, c), 0)

    return np.asarray(_hash(letters()), np.uint64) if len(start) else np.empty(0, np.uint64)


def _shapes(codes: np.ndarray, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Twice a number for what a token looks like, and one more if there is space before it; below 256."""
    size, kind, c = end - start, group[start], codes[start]
    upper = np.concatenate([[0], np.cumsum((codes >= 65) & (codes <= 90))])
    capitals, first = upper[end] - upper[start], (c >= 65) & (c <= 90)
    case = np.select([capitals == 0, first & (capitals == 1), capitals == size], [0, 1, 2], 3)
    letters = 10 + 5 * case + np.searchsorted([1, 2, 3, 6], size)
    digits = 2 + np.searchsorted([1, 2, 3, 4, 5, 6, 10], size)
    last = len(codes) - 1
    value = sum((codes[np.minimum(start + j, last)].astype(np.int64) - 48) * w for j, w in enumerate((100, 10, 1)))
    digits = np.where((size == 3) & (value > 255), _LARGE, digits)
    signs = np.where((c > 32) & (c < 127), c.astype(np.int64) - 3, _OTHER)
    spaced = np.where(start > 0, group[np.maximum(start - 1, 0)] == _SPACE, True)
    return 2 * np.select([kind == _DIGIT, kind == _LETTER], [digits, letters], signs) + spaced


# The field.

_NEVER = -1e4


def _allowed() -> np.ndarray:
    """0 where one label may follow another, else _NEVER."""
    table = np.zeros((LABELS, LABELS))
    for k in range(len(KINDS)):
        table[[y for y in range(LABELS) if y not in (1 + 2 * k, 2 + 2 * k)], 2 + 2 * k] = _NEVER
    return table


@dataclass
class Field:
    """Feature codes in order, weights of each (the last row is for all others), and of labels that follow each other."""

    codes: np.ndarray
    weights: np.ndarray
    follows: np.ndarray

    def rows(self, code: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        return np.where(self.codes[at] == code, at, len(self.codes)) if len(self.codes) else np.zeros(len(code), np.int64)

    def emissions(self, features: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(features[0]), LABELS), np.float32)
        for code in features:
            out += self.weights[self.rows(code)]
        return out


def padded(values: np.ndarray, first: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longest, pieces, ...) of some pieces, zeros behind their ends, and their sizes."""
    sizes = first[some + 1] - first[some]
    out = np.zeros((int(sizes.max(initial=0)), len(some), *values.shape[1:]), values.dtype)
    piece = np.repeat(np.arange(len(some)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[place, piece] = values[first[some][piece] + place]
    return out, sizes


def viterbi(emissions: np.ndarray, sizes: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """(longest, pieces) labels of the best path of each piece; what stands before and behind it is O."""
    longest, count = emissions.shape[:2]
    score, back = emissions[0] + follows[0], np.zeros((longest, count, LABELS), np.int8)
    for t in range(1, longest):
        live = t < sizes
        paths = score[:, :, None] + follows
        back[t] = paths.argmax(axis=1)
        score = np.where(live[:, None], paths.max(axis=1) + emissions[t], score)
    label, out = (score + follows[:, 0]).argmax(axis=1), np.zeros((longest, count), np.int8)
    for t in range(longest - 1, -1, -1):
        live = t < sizes
        out[t] = np.where(live, label, 0)
        if t:
            label = np.where(live, back[t, np.arange(count), label], label)
    return out


def marginals(emissions: np.ndarray, sizes: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition of each piece, label probabilities (longest, pieces, labels), and expected counts of neighbours, ends included.

    Sums ahead and behind are scaled to one at each place, and the scales kept.
    """
    longest, count = emissions.shape[:2]
    most = emissions.max(axis=2, keepdims=True)
    weight, step = np.exp(emissions - most), np.exp(follows)
    live = np.arange(longest)[:, None] < sizes
    ahead, behind, scale = np.zeros(emissions.shape), np.zeros(emissions.shape), np.ones((longest, count))
    for t in range(longest):
        now = (ahead[t - 1] @ step if t else step[0]) * weight[t]
        scale[t] = np.where(live[t], now.sum(axis=1), 1)
        ahead[t] = np.where(live[t][:, None], now / scale[t][:, None], ahead[t - 1])
    last = ahead[-1] @ step[:, 0]
    whole = np.log(last) + (np.log(scale) + most[:, :, 0] * live).sum(axis=0)
    behind[-1], pairs = step[:, 0], np.zeros((LABELS, LABELS))
    for t in range(longest - 1, 0, -1):
        here = weight[t] * behind[t]
        norm = ((ahead[t - 1] @ step) * here).sum(axis=1)
        pairs += step * (ahead[t - 1].T @ np.where(live[t][:, None], here / norm[:, None], 0))
        back = here @ step.T
        behind[t - 1] = np.where(live[t][:, None], back / back.sum(axis=1, keepdims=True), behind[t])
    found = ahead * behind
    found = found / found.sum(axis=2, keepdims=True) * live[:, :, None]
    pairs[0] += found[0].sum(axis=0)
    pairs[:, 0] += found[sizes - 1, np.arange(count)].sum(axis=0)
    return whole, found, pairs


def labels_of(found: Pieces, spans: Iterable[tuple[int, int, int]]) -> np.ndarray:
    """Labels of tokens, by the spans (kind, start, end) that they lie in; spans don't overlap."""
    out = np.zeros(len(found.start), np.int64)
    for kind, a, b in spans:
        inside = np.flatnonzero((found.start >= a) & (found.end <= b))
        out[inside] = 2 + 2 * kind
        out[inside[:1]] = 1 + 2 * kind
    return out


def gradient(field: Field, emissions: np.ndarray, sizes: np.ndarray, truth: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood of some pieces, and its slopes by emission (longest, pieces, labels) and by neighbours."""
    whole, found, pairs = marginals(emissions, sizes, field.follows)
    t, piece = np.nonzero(np.arange(len(truth))[:, None] < sizes)
    own, observed = emissions[t, piece, truth[t, piece]].sum(), np.zeros((LABELS, LABELS))
    np.add.at(observed, (0, truth[0]), 1)
    np.add.at(observed, (truth[sizes - 1, np.arange(len(sizes))], 0), 1)
    later = t > 0
    np.add.at(observed, (truth[t[later] - 1, piece[later]], truth[t[later], piece[later]]), 1)
    found[t, piece, truth[t, piece]] -= 1
    return float(whole.sum() - own - (observed * field.follows).sum()), found, pairs - observed


def train(rows: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 14, batch: int = 128, rate: float = 0.06, decay: float = 2e-5, seed: int = 11) -> Field:
    """Fit a field to texts and their spans by Adam; the same rows give the same field.  No rows give one that finds nothing."""
    every = [pieces(text) for text, _ in rows]
    truth = np.concatenate([labels_of(p, spans) for p, (_, spans) in zip(every, rows, strict=True)] or [np.empty(0, np.int64)])
    allowed = _allowed()
    if not len(truth):
        return Field(np.empty(0, np.int64), np.zeros((1, LABELS), np.float32), allowed)
    features = [np.concatenate([p.features[k] for p in every]) for k in range(len(_SHAPES) + len(_WORDS))]
    known, counts = np.unique(np.concatenate(features), return_counts=True)
    field = Field(known[counts > 1], np.zeros((int((counts > 1).sum()) + 1, LABELS)), allowed.copy())
    index = np.stack([field.rows(code) for code in features], axis=1)
    starts = np.cumsum([0] + [len(p.start) for p in every])
    first = np.concatenate([p.first[:-1] + s for p, s in zip(every, starts, strict=False)] + [[len(truth)]]).astype(np.int64)
    random, params = np.random.default_rng(seed), [field.weights, field.follows]
    means, squares, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = random.permutation(len(first) - 1)
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            where, sizes = padded(np.arange(len(truth)), first, some)
            emissions = field.weights[index[where]].sum(axis=2)
            _, by_emission, by_pair = gradient(field, emissions, sizes, truth[where])
            rows_, slopes = index[where].reshape(-1), np.repeat(by_emission.reshape(-1, LABELS), index.shape[1], axis=0)
            by_weight = np.stack([np.bincount(rows_, slopes[:, y], len(field.weights)) for y in range(LABELS)], axis=1)
            by_weight[-1] = 0  # stands for features that aren't known
            step += 1
            for p, g, m, s in zip(params, (by_weight / len(some) + decay * field.weights, by_pair / len(some)), means, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            field.follows[allowed < 0] = _NEVER
    field.weights = field.weights.astype(np.float32)
    return field


def fit(labelled: DataFrame) -> Field:
    """The field of a small table (text, spans), spans an array of structs (kind, start, end) in code points.

    At most ROWS rows are learned from, those of the lowest hashes of their
    text; rows with a null in either column are left out, and spans whose kind
    isn't among KINDS too.
    """
    known = labelled.where("text IS NOT NULL AND spans IS NOT NULL").select("text", "spans", F.xxhash64("text").alias("draw")).orderBy("draw", "text", F.col("spans").cast("string")).limit(ROWS)
    return train([(r.text, [(KINDS.index(s.kind), s.start, s.end) for s in r.spans if s.kind in KINDS]) for r in known.collect()])


def labelled(spark: SparkSession, rows: int = 1600, seed: int = 5) -> DataFrame:
    """The small table that the query's field is fitted on: sentences made by rule, see ``personal_examples``."""
    made = [(text, [(KINDS[k], a, b) for k, a, b in spans]) for text, spans in examples(rows, seed)]
    return spark.createDataFrame(made, "text string, spans array<struct<kind: string, start: int, end: int>>")


def decoded(field: Field, text: str, cells: int = 1 << 19) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the best path's spans, in the order of their starts; pieces of like length are decoded together."""
    found = pieces(text)
    if not len(found.start):
        return []
    emissions, sizes = field.emissions(found.features), np.diff(found.first)
    follows = field.follows.astype(np.float32)
    order, label = np.argsort(sizes, kind="stable"), np.zeros(len(found.start), np.int8)
    at = 0
    while at < len(order):
        # From the longest on, so many that the table of them stays within ``cells``.
        some = order[::-1][at : at + max(1, cells // (LABELS * int(sizes[order[len(order) - 1 - at]])))]
        table, n = padded(emissions, found.first, some)
        paths = viterbi(table, n, follows)
        where, _ = padded(np.arange(len(found.start)), found.first, some)
        live = np.arange(len(where))[:, None] < n
        label[where[live]] = paths[live]
        at += len(some)
    begins = np.flatnonzero(label % 2 == 1)
    goes_on = (label > 0) & (label % 2 == 0)
    ends = np.flatnonzero((label > 0) & ~np.r_[goes_on[1:], False])
    return [(int(label[b]) // 2, int(found.start[b]), int(found.end[e])) for b, e in zip(begins, ends, strict=True)]


_AT = re.compile(r"\s*(?:[\[({<]\s*(?:at|@|arroba|arobase)\s*[\])}>]|\s(?:at|arroba|arobase)\s|@)\s*", re.I)
_DOT = re.compile(r"\s*(?:[\[({<]\s*(?:dot|\.|punto|point|punkt)\s*[\])}>]|\s(?:dot|punto|point|punkt)\s|\.)\s*", re.I)


def is_valid(kind: int, body: str) -> bool:
    """Whether what the field found is what it says, read without its notation."""
    if len(body) > 200:
        return False
    if kind == 0:
        plain = _DOT.sub(".", _AT.sub("@", body))
        local, _, domain = plain.partition("@")
        return bool(local and _LOCAL.fullmatch(local) and _DOMAIN.fullmatch(domain) and re.search("[A-Za-z]{2}$", domain))
    digits = re.findall("[0-9]+", body)
    if kind == 1:
        return len(digits) == 4 and all(map(_is_byte, digits)) and "." in _DOT.sub(".", body)
    if re.search("[^\\W\\d_]", body):
        return False
    size = sum(map(len, digits))
    return (13 <= size <= 19 and luhn("".join(digits))) if kind == 2 else 7 <= size <= 15


def _together(texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """Parts (text's number, offset, part) that are decoded at once: about CHARS characters, cut between lines only."""
    some: list[tuple[int, int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = text.find("\n", at + CHARS) if len(text) - at > CHARS else -1
            end = len(text) if end < 0 else end
            if some and size + end - at > CHARS:
                yield some
                some, size = [], 0
            some.append((i, at, text[at:end]))
            size += end - at
            at = end
    if some:
        yield some


def spans_of(texts: list[str | None], field: Field) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, base) of each whole text, by kind, then start; those of the field overlap no pattern's."""
    plain = [t or "" for t in texts]
    out = [[(*s, True) for s in base_spans(t)] for t in plain]
    for some in _together(plain):
        offsets = np.cumsum([0] + [len(part) + 1 for _, _, part in some])
        for kind, a, b in decoded(field, "\n".join(part for _, _, part in some)):
            k = int(np.searchsorted(offsets, a, side="right")) - 1
            i, at, part = some[k]
            a, b = a - int(offsets[k]), b - int(offsets[k])
            if is_valid(kind, part[a:b]) and all(b + at <= s or e <= a + at for _, s, e, base in out[i] if base):
                out[i].append((kind, a + at, b + at, False))
    return [sorted(x) for x in out]


_SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def _found(spans: list[list[tuple[int, int, int, bool]]]) -> pa.Array:
    return pa.array([[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in x] for x in spans], _ARROW)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and spans (kind, start, end, base) of every row, in code points, by kind as listed, then start.

    ``base`` says whether a pattern found it; those overlap only across kinds.
    A null text counts as empty; repeated rows each get their row; null doc_ids
    are kept; an empty table gives an empty result; other columns don't matter.
    A narrow map, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _found(spans_of(batch.column(1).to_pylist(), field))], ["doc_id", "spans"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {_SPANS}")


def masked(text: str | None, spans: list[tuple[int, int, int, bool]]) -> str | None:
    """A text with each stretch that spans cover replaced by the kind of the first of them, in capitals and angle brackets."""
    if not spans:
        return text
    out, done = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= done:
            out += [text[done:a], f"<{KINDS[kind].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """``docs``, all columns as they are, whatever their names, but for texts with what ``find`` finds masked; null texts stay null."""
    names = docs.columns
    (body,) = unused(names, "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts = batch.column(len(names)).to_pylist()
            cut = pa.array([masked(t, s) for t, s in zip(texts, spans_of(texts, field), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([cut if c == "text" else batch.column(k) for k, c in enumerate(names)], names)

    return docs.select(*names, F.col("text").cast("string").alias(body)).mapInArrow(run, docs.schema)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), fit(labelled(spark)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = named(F.filter("spans", lambda s: s["base"]))
    return found.select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
