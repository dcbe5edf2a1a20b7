"""Optimizers and initialisers of parameter vectors on the driver, by name."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from steadfold.functions.bounds import RuleError


@dataclass
class Optimizer:
    """A rule for steps against a gradient.  ``memory`` is all that it remembers, and what a checkpoint keeps."""

    rate: float = 0.01
    decay: float = 0.0
    memory: dict[str, np.ndarray | int] = field(default_factory=dict)

    def step(self, params: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.memory["steps"] = int(self.memory.get("steps", 0)) + 1
        return params - self.rate * self.towards(grad + self.decay * params)

    def towards(self, grad: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def kept(self, name: str, grad: np.ndarray) -> np.ndarray:
        return np.asarray(self.memory.get(name, np.zeros_like(grad)))


@dataclass
class Sgd(Optimizer):
    momentum: float = 0.0
    dampening: float = 0.0

    def towards(self, grad: np.ndarray) -> np.ndarray:
        if not self.momentum:
            return grad
        first = self.memory["steps"] == 1
        self.memory["velocity"] = grad if first else self.momentum * self.kept("velocity", grad) + (1 - self.dampening) * grad
        return self.memory["velocity"]


@dataclass
class Adam(Optimizer):
    rate: float = 0.001
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8

    def towards(self, grad: np.ndarray) -> np.ndarray:
        t, (a, b) = self.memory["steps"], self.betas
        first = self.memory["first"] = a * self.kept("first", grad) + (1 - a) * grad
        second = self.memory["second"] = b * self.kept("second", grad) + (1 - b) * grad * grad
        return first / (1 - a**t) / (np.sqrt(second / (1 - b**t)) + self.eps)


@dataclass
class Adagrad(Optimizer):
    eps: float = 1e-10

    def towards(self, grad: np.ndarray) -> np.ndarray:
        total = self.memory["squares"] = self.kept("squares", grad) + grad * grad
        return grad / (np.sqrt(total) + self.eps)


@dataclass
class Rmsprop(Optimizer):
    alpha: float = 0.99
    eps: float = 1e-8

    def towards(self, grad: np.ndarray) -> np.ndarray:
        mean = self.memory["squares"] = self.alpha * self.kept("squares", grad) + (1 - self.alpha) * grad * grad
        return grad / (np.sqrt(mean) + self.eps)


OPTIMIZERS: dict[str, Callable[..., Optimizer]] = {"sgd": Sgd, "adam": Adam, "adagrad": Adagrad, "rmsprop": Rmsprop}


def _fans(shape: tuple[int, ...]) -> tuple[int, int]:
    """Inputs and outputs of a block of weights (outputs, inputs, further places)."""
    field_ = math.prod(shape[2:])
    return shape[1] * field_, shape[0] * field_


def _orthogonal(random: np.random.Generator, shape: tuple[int, ...]) -> np.ndarray:
    rows, columns = shape[0], math.prod(shape[1:])
    q, r = np.linalg.qr(random.normal(size=(max(rows, columns), min(rows, columns))))
    q = q * np.sign(np.diag(r))
    return (q if rows >= columns else q.T).reshape(shape)


#: Initialisers by name: of a generator and a block's shape.
INITIALISERS: dict[str, Callable[..., np.ndarray]] = {
    "zeros": lambda random, shape: np.zeros(shape),
    "ones": lambda random, shape: np.ones(shape),
    "constant": lambda random, shape, val=0.0: np.full(shape, float(val)),
    "eye": lambda random, shape: np.eye(*shape),
    "uniform": lambda random, shape, a=0.0, b=1.0: random.uniform(a, b, shape),
    "normal": lambda random, shape, mean=0.0, std=1.0: random.normal(mean, std, shape),
    "xavier_uniform": lambda random, shape, gain=1.0: random.uniform(-1, 1, shape) * gain * math.sqrt(6 / sum(_fans(shape))),
    "xavier_normal": lambda random, shape, gain=1.0: random.normal(0, gain * math.sqrt(2 / sum(_fans(shape))), shape),
    "kaiming_uniform": lambda random, shape: random.uniform(-1, 1, shape) * math.sqrt(6 / _fans(shape)[0]),
    "kaiming_normal": lambda random, shape: random.normal(0, math.sqrt(2 / _fans(shape)[0]), shape),
    "orthogonal": _orthogonal,
}


def optimizer(name: str, **options: object) -> Optimizer:
    if name not in OPTIMIZERS:
        raise RuleError(f"no optimizer is named {name}; there are {', '.join(OPTIMIZERS)}")
    return OPTIMIZERS[name](**options)


def register(table: dict[str, Callable], name: str, made: Callable) -> None:
    """Add an optimizer or an initialiser of one's own; a name that is taken is refused."""
    if name in table:
        raise RuleError(f"{name} is there already")
    table[name] = made


def initial(shapes: list[tuple[int, ...]], multi: str = "kaiming_uniform", mono: str = "zeros", seed: int = 0) -> np.ndarray:
    """A flat vector of parameters: ``multi`` for blocks of two dimensions or more, ``mono`` for the others."""
    random, parts = np.random.default_rng(seed), []
    for shape in shapes:
        name = multi if len(shape) > 1 else mono
        if name not in INITIALISERS:
            raise RuleError(f"no initialiser is named {name}; there are {', '.join(INITIALISERS)}")
        parts.append(INITIALISERS[name](random, shape).ravel())
    return np.concatenate(parts) if parts else np.empty(0)
