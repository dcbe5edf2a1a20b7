"""Losses, criteria and models as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from steadfold.functions import slopes
from steadfold.functions.bounds import RuleError
from steadfold.functions.slopes import Formula
from steadfold.functions.vectors import dot, l1_norm, norm, sigmoid


def mse(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def weighted_mse(p: Column, y: Column, w: Column) -> Column:
    return F.avg(w * (p - y) * (p - y))


def bce(p: Column, y: Column) -> Column:
    """Binary cross entropy; logarithms are bounded below by -100."""
    log = lambda x: F.when(x <= 0, F.lit(-100.0)).otherwise(F.greatest(F.lit(-100.0), F.ln(x)))
    return F.avg(-(y * log(p) + (1 - y) * log(1 - p)))


def nll(log_probabilities: Column, target: Column) -> Column:
    """Negative log likelihood of the target class, counted from 0."""
    return F.avg(-F.get(log_probabilities, target))


#: What a sample adds to a loss, from a model's outputs and the target.
Term = Callable[[Sequence[Formula], Column], Formula]


@dataclass(frozen=True)
class Loss:
    """A loss over (output, target, parameters); sums and multiples of losses are losses.

    ``terms`` are its means over samples as formulas, with their weights, and
    ``penalties`` its parts that depend on the parameters alone, l1 or l2, with
    theirs: what a gradient is derived from.  A loss without any of them can be
    measured, but not trained with.
    """

    of: Callable[[Column, Column, Column], Column]
    terms: tuple[tuple[float, Term], ...] = ()
    penalties: tuple[tuple[float, str], ...] = ()
    trainable: bool = True

    def __post_init__(self) -> None:
        if not self.terms and not self.penalties:
            object.__setattr__(self, "trainable", False)

    def __call__(self, output: Column, target: Column, params: Column) -> Column:
        return self.of(output, target, params)

    def __add__(self, other: Loss) -> Loss:
        return Loss(lambda o, t, p: self(o, t, p) + other(o, t, p), self.terms + other.terms, self.penalties + other.penalties, self.trainable and other.trainable)

    def __mul__(self, by: float) -> Loss:
        return self.times(by)

    __rmul__ = __mul__

    def times(self, by: float, compat: bool = False) -> Loss:
        """A multiple; ``compat`` multiplies twice, as the original does."""
        by = by * by if compat else by
        scaled = lambda parts: tuple((w * by, x) for w, x in parts)
        return Loss(lambda o, t, p: self(o, t, p) * by, scaled(self.terms), scaled(self.penalties), self.trainable)


def of_samples(each: Term, of: Callable[[Column, Column], Column] | None = None) -> Loss:
    """A loss that is the mean of a formula; ``of`` measures it in another way, for outputs that aren't one number."""
    plain = lambda o, t: F.avg(each([slopes.known(o)], t).column())
    return Loss(lambda o, t, p: (of or plain)(o, t), ((1.0, each),))


def bce_with_logits(z: Column, y: Column) -> Column:
    """Binary cross entropy of a logit, without overflow."""
    return F.avg(F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z))))


def huber(p: Column, y: Column, delta: float = 1.0) -> Column:
    """Half the squared gap up to ``delta``, a line beyond."""
    gap = F.abs(p - y)
    return F.avg(F.when(gap <= delta, 0.5 * gap * gap).otherwise(delta * (gap - 0.5 * delta)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Negative log likelihood of the target class, counted from 0, of logits."""
    top = F.array_max(logits)
    return F.avg(top + F.ln(F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v - top))) - F.get(logits, target))


def _bce(o: Sequence[Formula], y: Column) -> Formula:
    return -(slopes.log(o[0], -100) * y + slopes.log(1 - o[0], -100) * (1 - y))


def _bce_with_logits(o: Sequence[Formula], y: Column) -> Formula:
    z = o[0]
    return slopes.where(lambda c: c > 0, z, z, slopes.number(0)) - z * y + slopes.log1p(slopes.exp(-slopes.absolute(z)))


def _huber(o: Sequence[Formula], y: Column) -> Formula:
    gap = slopes.absolute(o[0] - y)
    return slopes.where(lambda c: c <= 1, gap, 0.5 * gap * gap, gap - 0.5)


LOSSES = {
    "mse": of_samples(lambda o, y: (o[0] - y) * (o[0] - y), mse),
    "bce": of_samples(_bce, bce),
    "nll": of_samples(lambda o, y: -slopes.picked(o, y), nll),
    "l1": Loss(lambda o, t, p: F.max(l1_norm(p)), penalties=((1.0, "l1"),)),
    "l2": Loss(lambda o, t, p: F.max(norm(p)), penalties=((1.0, "l2"),)),
    "bcewithlogits": of_samples(_bce_with_logits, bce_with_logits),
    "huber": of_samples(_huber, huber),
    "smoothl1": of_samples(_huber, huber),
    "crossentropy": of_samples(lambda o, y: slopes.log_sum_exp(o) - slopes.picked(o, y), cross_entropy),
    "softmargin": of_samples(lambda o, y: slopes.log1p(slopes.exp(-(o[0] * y))), lambda o, t: F.avg(F.log1p(F.exp(-o * t)))),
}


def named(text: str) -> Loss:
    """A registered loss by name, or a sum of multiples of some, such as ``0.5*mse + 2*bce + 0.01*l2``."""
    found = []
    for part in text.split("+"):
        weight, _, name = part.rpartition("*")
        if name.strip() not in LOSSES:
            raise RuleError(f"no loss is named {name.strip()}; there are {', '.join(LOSSES)}")
        try:
            found.append(LOSSES[name.strip()] if not weight else LOSSES[name.strip()] * float(weight))
        except ValueError as error:
            raise RuleError(f"{weight.strip()} isn't a multiple of a loss") from error
    return reduce(lambda a, b: a + b, found)


def register(name: str, loss: Loss) -> None:
    """Add a loss of one's own; a name that is taken is refused.  One that has terms can be trained with."""
    if name in LOSSES:
        raise RuleError(f"there is a loss named {name} already")
    LOSSES[name] = loss


def in_top_k(logits: Column, target: Column, k: int) -> Column:
    """1 if the target class is among the k largest logits, the smaller class first of equal ones, else 0."""
    better = F.size(F.filter(F.transform(logits, lambda x, i: (x > F.get(logits, target)) | ((x == F.get(logits, target)) & (i < target))), lambda b: b))
    return (better < k).cast("int")


def sigmoid_right(p: Column, y: Column) -> Column:
    """1 if the output is less than a half away from the target, else 0."""
    return (F.abs(y - p) < 0.5).cast("int")


def linear(x: Column, w: Column, b: Column) -> Column:
    return dot(x, w) + b


def logit(x: Column, w: Column, b: Column) -> Column:
    return sigmoid(linear(x, w, b))
