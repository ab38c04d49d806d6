"""Fusion, calibration and losses of probabilities as column expressions; everything stays in generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def clip(p: Column, eps: float = EPS) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def logit(p: Column, eps: float = EPS) -> Column:
    c = clip(p, eps)
    return F.ln(c) - F.log1p(-c)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def temperature(p: Column, t: float) -> Column:
    """A probability recalibrated by temperature; logits are kept within 60."""
    return sigmoid(F.least(F.greatest(logit(p) / t, F.lit(-60.0)), F.lit(60.0)))


def _shares(n: int, weights: Sequence[float] | None) -> list[float]:
    given = list(weights) if weights is not None else [1.0] * n
    if len(given) != n or not n:
        raise ValueError("one weight per score is needed")
    return [w / sum(given) for w in given]


def weighted_mean(ps: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    out = None
    for p, w in zip(ps, _shares(len(ps), weights)):
        out = p * w if out is None else out + p * w
    return out


def logit_mean(ps: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    return sigmoid(weighted_mean([logit(p) for p in ps], weights))


def shares(spec: dict) -> dict[str, float]:
    """Each expert's part in a nested group of weighted experts.

    A group is linear in its experts, so any nesting comes down to one number per expert: the product of the relative weights
    on the way to it, added up where it stands several times. Weights default to 1.
    """
    out: dict[str, float] = {}
    open_groups = [(spec, 1.0)]
    while open_groups:
        node, part = open_groups.pop()
        if "expert" in node:
            out[node["expert"]] = out.get(node["expert"], 0.0) + part
            continue
        members = node.get("children") or []
        if not members:
            raise ValueError("a group needs an expert or members")
        weights = [float(m.get("weight", 1.0)) for m in members]
        open_groups += [(m, part * w / sum(weights)) for m, w in zip(members, weights)]
    return out


def dot(parts: dict[str, float], values: dict[str, Column]) -> Column:
    """The weighted sum of the experts' values that ``parts`` names."""
    if missing := sorted(parts.keys() - values.keys()):
        raise KeyError(f"no scores of {missing}")
    terms = [values[name] * c for name, c in sorted(parts.items())]
    return sum(terms[1:], terms[0])


#: The published tree of five experts, m1 to m5.
PUBLISHED = {"children": [
    {"weight": 0.7, "children": [
        {"weight": 0.7, "children": [{"weight": 0.75, "expert": "m1"}, {"weight": 0.15, "expert": "m2"}, {"weight": 0.10, "expert": "m3"}]},
        {"weight": 0.3, "expert": "m4"}]},
    {"weight": 0.3, "expert": "m5"}]}

#: From which logits on the published gate trusts its experts, by how much it moves, who votes, how many must, against whom.
TRUSTED = {"m4": 8.0, "m5": 3.0}
SHIFT = 2.5
VOTERS = ("m1", "m2", "m3", "m5")
QUORUM = 3
DISSENTER = "m4"


@dataclass(frozen=True)
class Gate:
    """A decision table over the directions (-1, 0, 1) of logits.

    ======================================================  ==========================================
    a quorum of voters shares the votes' balance and the    the plain fusion, where it goes without the
    dissenter points elsewhere                              dissenter
    all trusted experts point one way beyond their bounds,  the fusion, moved that way by ``shift``
    the fusion does not
    else                                                    the fusion
    ======================================================  ==========================================
    """

    trusted: dict[str, float] = field(default_factory=lambda: dict(TRUSTED))
    shift: float = SHIFT
    voters: tuple[str, ...] = VOTERS
    quorum: int = QUORUM
    dissenter: str = DISSENTER

    def pointing(self, logits: dict[str, Column]) -> Column:
        """The way that all trusted experts point beyond their bounds; 0 if they don't, or one is absent."""
        if not self.trusted.keys() <= logits.keys():
            return F.lit(0)
        way = lambda e, bound: F.when(logits[e] >= max(bound, 0.0), F.signum(logits[e])).when(logits[e] <= -bound, F.lit(-1.0)).otherwise(F.lit(0.0))
        ways = F.array(*[way(e, b) for e, b in self.trusted.items()])
        return F.when(F.array_min(ways) == F.array_max(ways), F.array_max(ways)).otherwise(F.lit(0.0))

    def outvoted(self, logits: dict[str, Column], parts: dict[str, float]) -> Column:
        votes = [F.signum(logits[v]) for v in self.voters if v in logits]
        if self.dissenter in parts or self.dissenter not in logits or len(votes) < self.quorum:
            return F.lit(False)
        ballot = F.array(*votes)
        balance = F.signum(F.aggregate(ballot, F.lit(0.0), lambda n, v: n + v))
        behind = F.size(F.filter(ballot, lambda v: v == balance))
        return (behind >= self.quorum) & (F.signum(logits[self.dissenter]) != balance)

    def decide(self, parts: dict[str, float], logits: dict[str, Column]) -> Column:
        fusion = dot(parts, logits)
        way = self.pointing(logits)
        moved = F.when((way != 0) & (way * fusion <= 0), fusion + way * self.shift).otherwise(fusion)
        return F.when(self.outvoted(logits, parts), fusion).otherwise(moved)


def _hierarchical(values: dict[str, Column], weights, tree, gate: Gate | None) -> Column:
    parts = shares(tree or PUBLISHED)
    return dot(parts, values) if gate is None else sigmoid(gate.decide(parts, {n: logit(p) for n, p in values.items()}))


def _listed(values: dict[str, Column], weights: dict[str, float] | None) -> list[float] | None:
    return [weights.get(n, 1.0) for n in values] if weights else None


#: How scores become one, by mode.
FUSIONS = {
    "mean": lambda values, weights, tree, gate: weighted_mean(list(values.values())),
    "weighted": lambda values, weights, tree, gate: weighted_mean(list(values.values()), _listed(values, weights)),
    "logit": lambda values, weights, tree, gate: logit_mean(list(values.values()), _listed(values, weights)),
    "hierarchical": _hierarchical,
}


def fuse(values: dict[str, Column], mode: str = "mean", weights: dict[str, float] | None = None, tree: dict | None = None, gate: Gate | None = None) -> Column:
    """One probability from several, by one of FUSIONS; logits are derived where a mode needs them."""
    if mode not in FUSIONS:
        raise ValueError(f"unknown mode {mode!r}")
    return FUSIONS[mode](values, weights, tree, gate)


def linear(values: Sequence[Column], means: Sequence[float], scales: Sequence[float], coefficients: Sequence[float], intercept: float, a: float = -1.0, b: float = 0.0) -> Column:
    """Standardise, take the decision value of a linear machine, and map it by a fitted sigmoid 1 / (1 + exp(a f + b))."""
    f = F.lit(intercept)
    for v, m, s, c in zip(values, means, scales, coefficients):
        f = f + (v - m) / s * c
    return 1 / (1 + F.exp(a * f + b))


def cross_entropy(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def focal(z: Column, y: Column, gamma: float = 2.0, alpha: float = 0.5) -> Column:
    p = sigmoid(z)
    right = p * y + (1 - p) * (1 - y)
    loss = cross_entropy(z, y) * F.pow(F.greatest(1 - right, F.lit(EPS)), F.lit(gamma))
    return loss * (alpha * y + (1 - alpha) * (1 - y)) if alpha >= 0 else loss


def bernoulli_kl(z: Column, other: Column) -> Column:
    p, q = clip(sigmoid(z)), clip(sigmoid(other))
    return p * F.ln(p / q) + (1 - p) * F.ln((1 - p) / (1 - q))


def unit(vector: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def mean_squared(a: Column, b: Column) -> Column:
    parts = F.zip_with(a, b, lambda x, y: F.pow(x - y, F.lit(2.0)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def severity_value(severity: Column, low: float, high: float, whole: bool = False) -> Column:
    v = low + (high - low) * (F.least(F.greatest(severity, F.lit(0.0)), F.lit(5.0)) / 5)
    return F.bround(v, 0) if whole else v


def learning_rate(step: Column, warmup: int, total: int) -> Column:
    """Factor of the rate: linear warm-up, then half a cosine."""
    progress = F.least(F.lit(1.0), (step - warmup) / max(1, total - warmup))
    return F.when(step < warmup, (step + 1) / warmup).otherwise(0.5 * (1 + F.cos(F.lit(math.pi) * progress)))


def decision(p: Column, threshold: float) -> Column:
    """1, 0, or null where there is no probability."""
    return F.when(p.isNotNull() & ~F.isnan(p), (p >= threshold).cast("int"))


def confidence(p: Column, threshold: float) -> Column:
    return F.when(decision(p, threshold) == 1, p).when(decision(p, threshold) == 0, 1 - p)


def label_name(label: Column) -> Column:
    return F.when(label == 1, "FAKE").when(label == 0, "REAL").otherwise("SKIPPED")


def contract_holds(p: Column) -> Column:
    """A score is present, finite and within [0, 1]."""
    return p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p <= 1)
