"""Networks as layers in numpy, for models that column expressions can't hold: outputs and gradients of batches in Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfold.functions.bounds import RuleError
from steadfold.operators.rules import wide_form


@dataclass
class Dense:
    """Weights (outputs, inputs) and a bias."""

    inputs: int
    outputs: int

    @property
    def shapes(self) -> list[tuple[int, ...]]:
        return [(self.outputs, self.inputs), (self.outputs,)]

    def forward(self, x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, object]:
        x = x.reshape(len(x), -1)
        return x @ w.T + b, x

    def backward(self, d: np.ndarray, x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        return d @ w, [d.T @ x, d.sum(axis=0)]


@dataclass
class Convolution:
    """Square filters over images of ``inputs`` channels, without padding; flat rows are taken as square images."""

    inputs: int
    outputs: int
    kernel: int

    @property
    def shapes(self) -> list[tuple[int, ...]]:
        return [(self.outputs, self.inputs, self.kernel, self.kernel), (self.outputs,)]

    def forward(self, x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, object]:
        if x.ndim == 2:
            side = round((x.shape[1] / self.inputs) ** 0.5)
            x = x.reshape(len(x), self.inputs, side, side)
        views = np.lib.stride_tricks.sliding_window_view(x, (self.kernel, self.kernel), axis=(2, 3))
        return np.einsum("nchwij,ocij->nohw", views, w, optimize=True) + b[:, None, None], x

    def backward(self, d: np.ndarray, x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        views = np.lib.stride_tricks.sliding_window_view(x, (self.kernel, self.kernel), axis=(2, 3))
        back = np.zeros_like(x)
        for i in range(self.kernel):
            for j in range(self.kernel):
                back[:, :, i : i + d.shape[2], j : j + d.shape[3]] += np.einsum("nohw,oc->nchw", d, w[:, :, i, j], optimize=True)
        return back, [np.einsum("nchwij,nohw->ocij", views, d, optimize=True), d.sum(axis=(0, 2, 3))]


@dataclass
class Pool:
    """The largest of each two by two places; an odd last row or column is left out."""

    shapes: list[tuple[int, ...]] = field(default_factory=list)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, object]:
        n, c, h, w = x.shape
        cells = x[:, :, : h // 2 * 2, : w // 2 * 2].reshape(n, c, h // 2, 2, w // 2, 2).transpose(0, 1, 2, 4, 3, 5).reshape(n, c, h // 2, w // 2, 4)
        at = cells.argmax(axis=-1)
        return np.take_along_axis(cells, at[..., None], axis=-1)[..., 0], (x.shape, at)

    def backward(self, d: np.ndarray, seen: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
        (n, c, h, w), at = seen
        back = np.zeros((n, c, h, w))
        i, j = np.indices(at.shape[2:])
        np.add.at(back, (np.arange(n)[:, None, None, None], np.arange(c)[None, :, None, None], 2 * i + at // 2, 2 * j + at % 2), d.reshape(at.shape))
        return back, []


@dataclass
class Rectifier:
    shapes: list[tuple[int, ...]] = field(default_factory=list)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, object]:
        return np.maximum(x, 0), x

    def backward(self, d: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        return d.reshape(x.shape) * (x > 0), []


@dataclass
class LogSoftmax:
    shapes: list[tuple[int, ...]] = field(default_factory=list)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, object]:
        top = x - x.max(axis=1, keepdims=True)
        out = top - np.log(np.exp(top).sum(axis=1, keepdims=True))
        return out, out

    def backward(self, d: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        return d - np.exp(out) * d.sum(axis=1, keepdims=True), []


@dataclass
class Sigmoid:
    shapes: list[tuple[int, ...]] = field(default_factory=list)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, object]:
        out = 1 / (1 + np.exp(-x))
        return out, out

    def backward(self, d: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        return d * out * (1 - out), []


@dataclass
class Network:
    """Layers in order; parameters are one flat vector, the layers' blocks one after another."""

    layers: list

    @property
    def shapes(self) -> list[tuple[int, ...]]:
        return [s for layer in self.layers for s in layer.shapes]

    def blocks(self, params: np.ndarray) -> list[list[np.ndarray]]:
        found, at = [], 0
        for layer in self.layers:
            found.append([])
            for shape in layer.shapes:
                size = int(np.prod(shape))
                found[-1].append(params[at : at + size].reshape(shape))
                at += size
        if at != len(params):
            raise RuleError(f"the network has {at} parameters, not {len(params)}")
        return found

    def output(self, params: np.ndarray, x: np.ndarray) -> np.ndarray:
        for layer, own in zip(self.layers, self.blocks(params), strict=True):
            x, _ = layer.forward(x, *own)
        return x

    def loss_and_gradient(self, params: np.ndarray, x: np.ndarray, y: np.ndarray, loss: str) -> tuple[float, np.ndarray]:
        """Sums over the rows of the loss and of its gradient."""
        blocks, seen = self.blocks(params), []
        for layer, own in zip(self.layers, blocks, strict=True):
            x, kept = layer.forward(x, *own)
            seen.append(kept)
        value, d = OUTPUT_LOSSES[loss](x, y)
        grads: list[np.ndarray] = []
        for layer, own, kept in zip(reversed(self.layers), reversed(blocks), reversed(seen), strict=True):
            d, here = layer.backward(d, kept, *own)
            grads = [g.ravel() for g in here] + grads
        return value, np.concatenate(grads)


def _nll(out: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    rows, d = np.arange(len(out)), np.zeros_like(out)
    d[rows, y.astype(int)] = -1
    return float(-out[rows, y.astype(int)].sum()), d


def _mse(out: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    gap = out - y.reshape(len(out), -1)
    return float((gap * gap).sum() / gap.shape[1]), 2 * gap / gap.shape[1]


#: Losses by name: of outputs and targets, the sum over rows and its slope.
OUTPUT_LOSSES: dict[str, Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]]] = {"nll": _nll, "mse": _mse}


def full(side: int = 28, hidden: int = 100, classes: int = 10) -> Network:
    return Network([Dense(side * side, hidden), Rectifier(), Dense(hidden, classes), LogSoftmax()])


def conv(side: int = 28, channels: tuple[int, int] = (20, 50), kernel: int = 5, hidden: int = 500, classes: int = 10) -> Network:
    """Two blocks of convolution, rectifier and pooling, then two dense layers."""
    left = ((side - kernel + 1) // 2 - kernel + 1) // 2
    return Network([Convolution(1, channels[0], kernel), Rectifier(), Pool(), Convolution(*channels, kernel), Rectifier(), Pool(), Dense(channels[1] * left * left, hidden), Rectifier(), Dense(hidden, classes), LogSoftmax()])


#: Networks by name, made from options; the sizes that aren't given are fixed values.
MODELS: dict[str, Callable[..., Network]] = {
    "linear": lambda inputs, outputs=1: Network([Dense(inputs, outputs)]),
    "logit": lambda inputs, outputs=1: Network([Dense(inputs, outputs), Sigmoid()]),
    "full": full,
    "conv": conv,
}


def register(name: str, model: Callable[..., Network]) -> None:
    """Add a model of one's own; a name that is taken is refused."""
    if name in MODELS:
        raise RuleError(f"there is a model named {name} already")
    MODELS[name] = model


def predict(rows: DataFrame, network: Network, params: np.ndarray) -> DataFrame:
    """(id, x) -> (id, out), in Arrow batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield pd.DataFrame({"id": part["id"], "out": list(network.output(params, np.stack(part["x"].to_numpy()).astype(float)))})

    return rows.select("id", "x").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, out array<double>")


def gradients(samples: DataFrame, network: Network, params: np.ndarray, loss: str) -> DataFrame:
    """(step, worker, x, y) -> (step, worker, g, loss): means over each worker's rows.

    Each Arrow batch gives one sum for each worker it has rows of; sums are
    added coordinate by coordinate, so no task holds a worker's rows.
    """
    kinds = dict(samples.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for (step, worker), own in part.groupby(["step", "worker"]):
                value, grad = network.loss_and_gradient(params, np.stack(own["x"].to_numpy()).astype(float), own["y"].to_numpy(float), loss)
                found.append((step, worker, len(own), [value, *grad.tolist()]))
            yield pd.DataFrame(found, columns=["step", "worker", "n", "sums"])

    sums = samples.select("step", "worker", "x", "y").mapInPandas(run, f"step {kinds['step']}, worker {kinds['worker']}, n long, sums array<double>")
    each = sums.select("step", "worker", "n", F.posexplode("sums").alias("pos", "v")).groupBy("step", "worker", "pos").agg((F.sum("v") / F.sum("n")).alias("val"))
    wide = wide_form(each, "step", "worker")
    return wide.select("step", "worker", F.expr("slice(g, 2, size(g) - 1)").alias("g"), F.col("g")[0].alias("loss"))
