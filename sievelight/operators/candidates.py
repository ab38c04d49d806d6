"""Fusion candidates, fitted and cross-validated without leaving the cluster.

A candidate is registered under its name. Those that are linear in some design of the experts' scores (logistic regressions,
splines, linear machines) are fitted by Newton's method on sums: one pass over the rows gives the gradients and curvatures of
all candidates, penalties and folds at once, so five folds with an inner grid cost some dozen passes, and only a few numbers
per candidate reach the driver. Trees and the small network are those of Spark's own library.

Folds are those of ``fold`` (0 to FOLDS - 1); ``inner`` (0 to 14) divides the training rows once more, by threes for the choice
of the penalty and by fives for what a stacked candidate keeps back for its calibration. Rows need y (0 or 1) and scores
without nulls; a fold without rows gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.operators.skew import random_rank
from sievelight.session import materialise

FOLDS, INNER, CALIBRATION = 5, 3, 5
EPS = 1e-7
ROUNDS = 25


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


# Designs: what a linear candidate is linear in, of scores (rows, experts) and of the same standardised.


def plain(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    return x


def pairwise(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.column_stack([x, *[x[:, i] * x[:, j] for i, j in combinations(range(x.shape[1]), 2)]])


def splines(knots: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Quadratic splines of each score with evenly spaced inner knots."""
    inner = np.linspace(0, 1, knots)[1:-1]
    return lambda x, z: np.column_stack([x, x**2, *[np.maximum(x - t, 0) ** 2 for t in inner]])


def fourier(gamma: float, size: int = 40, seed: int = 1337) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Random cosines whose products approximate a Gaussian kernel of the standardised scores."""

    def design(x: np.ndarray, z: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(seed)
        w, b = rng.normal(0, np.sqrt(2 * gamma), (z.shape[1], size)), rng.uniform(0, 2 * np.pi, size)
        return np.sqrt(2 / size) * np.cos(z @ w + b)

    return design


@dataclass(frozen=True)
class Candidate:
    """kind: mean, constrained, linear or library. A linear one has designs and penalties to choose among by inner folds."""

    name: str
    kind: str
    designs: tuple[Callable, ...] = ()
    penalties: tuple[float, ...] = (1.0,)
    loss: str = "log"
    calibrated: bool = False
    make: Callable | None = None


CANDIDATES: dict[str, Candidate] = {}


def register(candidate: Candidate) -> Candidate:
    if candidate.name in CANDIDATES:
        raise ValueError(f"candidate {candidate.name!r} is registered already")
    CANDIDATES[candidate.name] = candidate
    return candidate


def _forest(experts: list[str]):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=20, maxDepth=4, minInstancesPerNode=10, weightCol="weight", seed=1337)


def _boosted(experts: list[str]):
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(labelCol="y", featuresCol="features", maxIter=10, maxDepth=3, stepSize=0.2, subsamplingRate=0.8, seed=1337)


def _network(experts: list[str]):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(labelCol="y", featuresCol="features", layers=[len(experts), 8, 2], maxIter=40, seed=1337)


register(Candidate("equal_average", "mean"))
register(Candidate("constrained_mean", "constrained"))
register(Candidate("logistic", "linear", (plain,), (0.1, 1.0, 10.0)))
register(Candidate("logistic_pairs", "linear", (pairwise,), (0.1, 1.0, 10.0)))
register(Candidate("splines", "linear", (splines(3), splines(4), splines(5)), (0.1, 1.0)))
register(Candidate("svm_linear", "linear", (plain,), (0.1, 1.0, 10.0), "hinge", True))
register(Candidate("svm_gaussian", "linear", (fourier(0.1), fourier(1 / 3), fourier(1.0)), (0.1, 1.0, 10.0), "hinge", True))
register(Candidate("stacked", "linear", (plain,), (1.0,), "log", True))
register(Candidate("forest", "library", make=_forest))
register(Candidate("boosted", "library", make=_boosted))
register(Candidate("network", "library", make=_network))


# Fitting by sums.


@dataclass
class Fit:
    """One linear model in the making: its training rows are those outside ``fold`` that ``part`` keeps."""

    design: Callable
    penalty: float
    loss: str
    fold: int
    part: tuple[str, int] | None = None  # ("not3", g), ("not5", g) or ("is5", g) of inner; None is all
    base: Fit | None = None  # a fitted model whose decision value is the only feature
    means: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scales: np.ndarray = field(default_factory=lambda: np.zeros(0))
    raw: tuple[np.ndarray, np.ndarray] | None = None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def keeps(self, fold: np.ndarray, inner: np.ndarray) -> np.ndarray:
        some = fold != self.fold
        if self.part:
            how, g = self.part
            some &= {"not3": inner % INNER != g, "not5": inner // INNER != g, "is5": inner // INNER == g}[how]
        return some

    def features(self, x: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return self.base.decide(x)[:, None]
        return self.design(x, (x - self.raw[0]) / self.raw[1])

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(self.features(x) - self.means) / self.scales, np.ones(len(x))])

    def decide(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weights


def _sums(rows: DataFrame, experts: list[str], fits: list[Fit], measure: Callable) -> list[np.ndarray]:
    """For each fit the sum over its rows of ``measure(fit, x, y)``, an array. What the tasks have is added up in the cluster, so one array per fit reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list = [0.0] * len(fits)
        for batch in batches:
            x = np.column_stack([np.asarray(batch.column(i)) for i in range(len(experts))])
            y, fold, inner = (np.asarray(batch.column(len(experts) + i)) for i in range(3))
            for k, fit in enumerate(fits):
                some = measure.rows(fit, fold, inner) if hasattr(measure, "rows") else fit.keeps(fold, inner)
                if some.any():
                    totals[k] = totals[k] + measure(fit, x[some], y[some].astype(np.float64))
        yield from told({k: t for k, t in enumerate(totals) if not np.isscalar(t)})

    def told(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["k", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0.0) + np.frombuffer(v)
        yield from told(sums)

    picked = rows.select(*[F.col(e).cast("double") for e in experts], F.col("y").cast("int"), F.col("fold").cast("int"), F.col("inner").cast("int"))
    found = picked.mapInArrow(run, "k int, v binary").repartition("k").mapInArrow(add, "k int, v binary").collect()
    out = [np.zeros(0)] * len(fits)
    for r in found:
        out[r["k"]] = np.frombuffer(r["v"])
    return out


def _moments(of: Callable) -> Callable:
    def measure(fit: Fit, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = of(fit, x)
        return np.concatenate([[len(d)], d.sum(axis=0), (d**2).sum(axis=0)])

    return measure


def _spread(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = (len(total) - 1) // 2
    n = max(total[0], 1.0) if len(total) else 1.0
    mean = total[1 : 1 + p] / n
    sd = np.sqrt(np.maximum(total[1 + p :] / n - mean**2, 0))
    return mean, np.where(sd > 1e-12, sd, 1.0)


def _slope(fit: Fit, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature, laid end to end."""
    d = fit.scaled(x)
    s = d @ fit.weights
    if fit.loss == "log":
        p = sigmoid(s)
        loss, g, h = np.logaddexp(0, s) - y * s, p - y, p * (1 - p)
    else:
        sign = 2 * y - 1
        short = np.maximum(1 - sign * s, 0)
        loss, g, h = short**2, -2 * sign * short, 2.0 * (short > 0)
    return np.concatenate([[loss.sum()], d.T @ g, ((d * h[:, None]).T @ d).reshape(-1)])


def fit_all(rows: DataFrame, experts: list[str], fits: list[Fit]) -> None:
    """Fit all models together; each is left with its scales and weights."""
    if not fits:
        return
    for fit, total in zip(fits, _sums(rows, experts, fits, _moments(lambda f, x: x))):
        fit.raw = _spread(total) if len(total) else (np.zeros(len(experts)), np.ones(len(experts)))
    for fit, total in zip(fits, _sums(rows, experts, fits, _moments(lambda f, x: f.features(x)))):
        fit.means, fit.scales = _spread(total)
        fit.weights = np.zeros(len(fit.means) + 1)
    left = [f for f in fits if len(f.means)]
    past: dict[int, tuple[float, np.ndarray]] = {}
    for _ in range(ROUNDS):
        going = []
        for fit, total in zip(left, _sums(rows, experts, left, _slope)):
            p = len(fit.weights)
            free = np.r_[np.ones(p - 1), 0.0]  # the intercept is not held back
            value = fit.penalty * total[0] + 0.5 * float((free * fit.weights**2).sum())
            before = past.get(id(fit))
            if before and value > before[0] + 1e-9 * abs(before[0]):  # the step was too long: half of it
                fit.weights = (fit.weights + before[1]) / 2
                going.append(fit)
                continue
            past[id(fit)] = (value, fit.weights.copy())
            g = fit.penalty * total[1 : 1 + p] + free * fit.weights
            h = fit.penalty * total[1 + p :].reshape(p, p) + np.diag(free + 1e-9)
            step = np.linalg.solve(h, g)
            fit.weights = fit.weights - step
            if np.abs(step).max() > 1e-8:
                going.append(fit)
        left = going
        if not left:
            break


class _Held:
    """The loss on the inner fold that a fit left out."""

    @staticmethod
    def rows(fit: Fit, fold: np.ndarray, inner: np.ndarray) -> np.ndarray:
        return (fold != fit.fold) & (inner % INNER == fit.part[1])

    def __call__(self, fit: Fit, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return _slope(fit, x, y)[:1]


def fit_linear(rows: DataFrame, experts: list[str], candidates: list[Candidate], folds: list[int]) -> dict[tuple[str, int], Fit]:
    """By candidate and fold held out the fitted model: its design and penalty chosen on inner folds, fitted again on all training rows, calibrated where the candidate asks for it. Fold -1 holds out nothing."""
    tried = []
    for c in candidates:
        if len(c.designs) * len(c.penalties) > 1:
            tried += [(c.name, d, q, Fit(c.designs[d], q, c.loss, f, ("not3", g))) for f in folds for d in range(len(c.designs)) for q in c.penalties for g in range(INNER)]
    trials = [t[3] for t in tried]
    fit_all(rows, experts, trials)
    scores: dict[tuple, float] = {}
    for (name, d, q, fit), loss in zip(tried, _sums(rows, experts, trials, _Held()) if trials else []):
        scores[name, fit.fold, d, q] = scores.get((name, fit.fold, d, q), 0.0) + (loss[0] if len(loss) else 0.0)
    out: dict[tuple[str, int], Fit] = {}
    for c in candidates:
        for f in folds:
            options = [(scores.get((c.name, f, d, q), 0.0), d, q) for d in range(len(c.designs)) for q in c.penalties]
            _, d, q = min(options)
            out[c.name, f] = Fit(c.designs[d], q, c.loss, f, ("not5", 0) if c.calibrated and c.loss == "log" else None)
    fit_all(rows, experts, list(out.values()))
    # a sigmoid over decision values: of a stacked model on the rows kept back, of a machine on its training rows
    top = {k: Fit(plain, 1e4, "log", fit.fold, ("is5", 0) if fit.part else None, fit) for k, fit in out.items() if CANDIDATES[k[0]].calibrated}
    fit_all(rows, experts, list(top.values()))
    return out | top


def constrained(rows: DataFrame, experts: list[str], folds: list[int]) -> dict[int, np.ndarray]:
    """By fold held out the weights, in tenths, not negative and summing to one, of least log loss on the other rows; one pass for all."""
    grid = [np.array(w) / 10 for w in _tenths(len(experts))]

    def measure(fit: Fit, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = np.clip(np.stack([x @ w for w in grid], axis=1), EPS, 1 - EPS)
        return -(y[:, None] * np.log(p) + (1 - y[:, None]) * np.log(1 - p)).sum(axis=0)

    totals = _sums(rows, experts, [Fit(plain, 1.0, "log", f) for f in folds], measure)
    return {f: grid[int(np.argmin(np.round(t, 6)))] if len(t) else grid[0] for f, t in zip(folds, totals)}


def _tenths(n: int, whole: int = 10) -> list[tuple[int, ...]]:
    if n == 1:
        return [(whole,)]
    return [(k, *rest) for k in range(whole + 1) for rest in _tenths(n - 1, whole - k)]


def out_of_fold(rows: DataFrame, experts: list[str], names: list[str] | None = None) -> DataFrame:
    """(row_id, fold, model, y, p): each row's score by every candidate fitted on the other folds."""
    rows = materialise(rows.select("row_id", "fold", "inner", "y", *experts), "development")
    chosen = [CANDIDATES[n] for n in names or CANDIDATES]
    folds = list(range(FOLDS))
    linear = fit_linear(rows, experts, [c for c in chosen if c.kind == "linear"], folds)
    weights = constrained(rows, experts, folds) if any(c.kind == "constrained" for c in chosen) else {}
    told = [c.name for c in chosen if c.kind != "library"]
    kinds = {c.name: c.kind for c in chosen}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fold, y = (np.asarray(batch.column(i)) for i in range(3))
            x = np.column_stack([np.asarray(batch.column(3 + i)) for i in range(len(experts))])
            for name in told:
                p = x.mean(axis=1)
                for f in np.unique(fold):
                    of = fold == f
                    if kinds[name] == "linear":
                        p[of] = sigmoid(linear[name, int(f)].decide(x[of]))
                    elif kinds[name] == "constrained":
                        p[of] = np.clip(x[of] @ weights[int(f)], 0, 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(fold), pa.array([name] * len(ids)), pa.array(y), pa.array(p)], names=["row_id", "fold", "model", "y", "p"])

    picked = rows.select(F.col("row_id").cast("bigint"), F.col("fold").cast("bigint"), F.col("y").cast("int"), *[F.col(e).cast("double") for e in experts])
    schema = "row_id bigint, fold bigint, model string, y int, p double"
    out = picked.mapInArrow(run, schema)
    for c in chosen:
        if c.kind == "library":
            out = out.unionByName(_by_library(rows, experts, c, folds))
    return out


def _by_library(rows: DataFrame, experts: list[str], candidate: Candidate, folds: list[int]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assembled = VectorAssembler(inputCols=experts, outputCol="features").transform(rows.withColumn("y", F.col("y").cast("int")))
    parts = None
    for f in folds:
        counts = {r["y"]: r["n"] for r in rows.where(F.col("fold") != f).groupBy("y").agg(F.count("*").alias("n")).collect()}
        whole = sum(counts.values())
        if len(counts) < 2:
            continue  # one class has nothing to fit
        weight = F.when(F.col("y") == 1, whole / (2 * counts[1])).otherwise(whole / (2 * counts[0]))
        model = candidate.make(experts).fit(assembled.where(F.col("fold") != f).withColumn("weight", weight))
        p = vector_to_array("probability")[1]
        part = model.transform(assembled.where(F.col("fold") == f)).select(F.col("row_id").cast("bigint"), F.col("fold").cast("bigint"), F.lit(candidate.name).alias("model"), "y", p.alias("p"))
        parts = part if parts is None else parts.unionByName(part)
    return parts if parts is not None else rows.sparkSession.createDataFrame([], "row_id bigint, fold bigint, model string, y int, p double")


def importance(rows: DataFrame, experts: list[str], name: str = "logistic", threshold: float = 0.5) -> DataFrame:
    """(expert, weight, share, how): what a candidate fitted on all rows owes to each expert.

    A candidate that is linear in the scores themselves gives the shares of its absolute coefficients; any other the mean loss of
    balanced accuracy when an expert's scores are dealt out anew at random.
    """
    rows = materialise(rows.select("row_id", "fold", "inner", "y", *experts), "development")
    spark = rows.sparkSession
    candidate = CANDIDATES[name]
    if candidate.kind not in ("linear", "constrained"):
        raise ValueError(f"{name} is not fitted by sums")
    if candidate.kind == "constrained":
        found, how = constrained(rows, experts, [-1])[-1], "weight"
    else:
        fit = fit_linear(rows, experts, [candidate], [-1])[name, -1]
        linear = fit.base or fit
        if linear.design is plain:
            found, how = linear.weights[:-1], "coefficient"
        else:
            found, how = _by_permutation(rows, experts, fit, threshold), "permutation"
    whole = float(np.abs(found).sum()) or 1.0
    return spark.createDataFrame([(e, float(w), float(abs(w)) / whole, how) for e, w in zip(experts, found)], "expert string, weight double, share double, how string")


def _by_permutation(rows: DataFrame, experts: list[str], fit: Fit, threshold: float) -> np.ndarray:
    def balanced(some: DataFrame) -> float:
        def measure(f: Fit, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            up = sigmoid(f.decide(x)) >= threshold
            return np.array([(up & (y == 1)).sum(), (y == 1).sum(), (~up & (y == 0)).sum(), (y == 0).sum()], dtype=np.float64)

        tp, p, tn, n = _sums(some, experts, [fit], measure)[0]
        return (tp / max(p, 1) + tn / max(n, 1)) / 2

    plain_score, out = balanced(rows), []
    for e in experts:
        digits = lambda salt: F.sha2(F.concat(F.lit(f"{salt}:{e}:"), F.col("row_id").cast("string")), 256)  # noqa: E731, B023
        own = random_rank(rows.withColumn("_all", F.lit(0)), ["_all"], digits("a"))
        other = random_rank(rows.select("row_id", e).withColumn("_all", F.lit(0)), ["_all"], digits("b")).select("place", F.col(e).alias("_dealt"))
        dealt = own.join(other, "place").withColumn(e, F.col("_dealt"))
        out.append(plain_score - balanced(materialise(dealt.select("row_id", "fold", "inner", "y", *experts), "dealt")))
    return np.array(out)
