"""Scorers: a registry of functions from image batches to probabilities, run in Arrow batches under a checked contract."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions import images as I
from sievelight.functions import scores as P

Scorer = Callable[[list[np.ndarray]], np.ndarray]
_FACTORIES: dict[str, Callable[..., Scorer]] = {}


def register(name: str):
    def add(factory: Callable[..., Scorer]) -> Callable[..., Scorer]:
        if name in _FACTORIES:
            raise ValueError(f"scorer {name!r} is registered already")
        _FACTORIES[name] = factory
        return factory

    return add


def available() -> list[str]:
    return sorted(_FACTORIES)


def get(name: str, **options) -> Scorer:
    if name not in _FACTORIES:
        raise KeyError(f"no scorer {name!r}; there are {available()}")
    return _FACTORIES[name](**options)


@register("constant")
def constant(value: float = 0.5) -> Scorer:
    return lambda images: np.full(len(images), value)


@register("random")
def random(seed: int = 0) -> Scorer:
    """Depends on the image only, not on its neighbours."""
    return lambda images: np.array([I.generator(seed, int.from_bytes(i.tobytes()[:8].ljust(8, b"\0"), "big"), "random").random() for i in images])


@register("mean_intensity")
def mean_intensity() -> Scorer:
    return lambda images: np.array([I.mean_intensity(i) for i in images])


@register("mlp")
def mlp(weights: list | None = None) -> Scorer:
    """Layer norm, a hidden layer with GELU, and one output, over the flattened pixels; random weights if none are given."""

    def score(images: list[np.ndarray]) -> np.ndarray:
        x = np.stack([i.reshape(-1) for i in images]).astype(np.float64) / 255
        x = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5)
        rng = np.random.default_rng(7)
        a, b = weights or (rng.normal(0, 0.2, (x.shape[1], 16)), rng.normal(0, 0.2, 16))
        h = x @ np.asarray(a)
        h = 0.5 * h * (1 + np.tanh(np.sqrt(2 / np.pi) * (h + 0.044715 * h**3)))
        return 1 / (1 + np.exp(-(h @ np.asarray(b))))

    return score


def ensemble(rows: DataFrame, config: dict) -> DataFrame:
    """(row_id, score, one column per expert): several registered scorers, fused and calibrated as a configuration says.

    ``experts`` gives each its ``model`` (by default its name; not another ensemble) and options; ``fusion`` the mode, weights, tree
    and gate of ``scores.fuse``; ``calibration`` a temperature. Each image is decoded once for all experts; fusion stays in
    generated code. An image that has no score has none from any expert.
    """
    experts = config.get("experts") or {}
    if not experts:
        raise ValueError("an ensemble needs experts")
    if any(options.get("model", name) == "ensemble" for name, options in experts.items()):
        raise ValueError("an ensemble holds no ensemble")
    names = list(experts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [get(options.get("model", name), **{k: v for k, v in options.items() if k != "model"}) for name, options in experts.items()]
        for batch in batches:
            good, images = _readable(batch)
            columns = []
            for scorer in scorers:
                found = np.full(batch.num_rows, np.nan)
                if images:
                    found[good] = checked(scorer, images)
                columns.append(pa.array(found, from_pandas=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row_id", *names])

    scored = rows.select("row_id", "pixels", "side").mapInArrow(run, ", ".join(["row_id bigint", *[f"`{n}` double" for n in names]]))
    fusion = dict(config.get("fusion") or {})
    gate = fusion.get("gate")
    fused = P.fuse({n: F.col(f"`{n}`") for n in names}, fusion.get("mode", "mean"), fusion.get("weights"), fusion.get("tree"), P.Gate(**gate) if gate else None)
    t = (config.get("calibration") or {}).get("temperature")
    return scored.select("row_id", (P.temperature(fused, float(t)) if t else fused).alias("score"), *[f"`{n}`" for n in names])


def _readable(batch: pa.RecordBatch) -> tuple[list[int], list[np.ndarray]]:
    """The places of a batch's readable images, and these."""
    good, images = [], []
    for k, (p, s) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
        if p is not None and s and len(p) % s == 0 and p:
            good.append(k)
            images.append(np.array(p, dtype=np.uint8).reshape(s, -1, 1))
    return good, images


def checked(scorer: Scorer, images: list[np.ndarray]) -> np.ndarray:
    """Scores of the right number, finite and within [0, 1]; else an error."""
    out = np.asarray(scorer(images), dtype=np.float64)
    if out.shape != (len(images),):
        raise ValueError(f"{len(images)} images, scores of shape {out.shape}")
    if not np.isfinite(out).all() or (out < 0).any() or (out > 1).any():
        raise ValueError("scores must be finite and within [0, 1]")
    return out


def images_of(vectors: DataFrame, ident: str = "vec_id", column: str = "embedding", side: int = 8) -> DataFrame:
    """(ident, pixels binary): vectors as grey images, values around 0 spread over the grey levels."""
    level = lambda x: F.least(F.greatest(F.floor(x.cast("double") * 255 + 128), F.lit(0)), F.lit(255)).cast("int")
    return vectors.select(F.col(ident).alias("row_id"), F.transform(column, level).alias("pixels"), F.lit(side).alias("side"))


def each(rows: DataFrame, f: Callable[[int, np.ndarray], dict], schema: str) -> DataFrame:
    """f(row_id, image) of every row (row_id, pixels, side), as columns beside row_id; an image that fails has nulls."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, p, s in zip(*(batch.column(k).to_pylist() for k in range(3))):
                try:
                    out.append({"row_id": i} | f(i, np.array(p, dtype=np.uint8).reshape(s, -1, 1)))
                except (ValueError, TypeError):
                    out.append({"row_id": i} | dict.fromkeys(names))
            if out:
                yield from pa.Table.from_pylist(out, schema=_arrow(f"row_id bigint, {schema}")).to_batches()

    return rows.select("row_id", "pixels", "side").mapInArrow(run, f"row_id bigint, {schema}")


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<array<int>>": pa.list_(pa.list_(pa.int32()))}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def score(rows: DataFrame, name: str, **options) -> DataFrame:
    """(row_id, score) by a registered scorer, built once per task; unreadable images have no score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = get(name, **options)
        for batch in batches:
            ids = batch.column(0)
            good, images = _readable(batch)
            found = np.full(batch.num_rows, np.nan)
            if images:
                found[good] = checked(scorer, images)
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, from_pandas=True)], names=["row_id", "score"])

    return rows.select("row_id", "pixels", "side").mapInArrow(run, "row_id bigint, score double")
