"""Writers: manifests, predictions, hash lists, score caches, tables as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.sources.readers import MANIFEST_COLUMNS

#: White space around values is part of them.
EXACT = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def manifest_csv(rows: DataFrame, path: str) -> None:
    """Fixed columns, ordered by source, split and path over all files; a missing text is an empty one in such files."""
    rows.select(*MANIFEST_COLUMNS).orderBy(*[F.coalesce(c, F.lit("")) for c in ("source", "split", "path")]).write.options(**EXACT).csv(path)


def split_manifests(rows: DataFrame, path: str) -> None:
    """Manifest files in one folder per split."""
    rows.select(*MANIFEST_COLUMNS).write.partitionBy("split").options(**EXACT).csv(path)


def _probability(p: str):
    c = F.col(p)
    return F.when(c.isNull() | F.isnan(c), None).otherwise(c)


def prediction_records(rows: DataFrame, path: str = "image_path", p: str = "pred", fallback: float = 0.5) -> DataFrame:
    """image_path and pred as sinks without missing values have them: fallback, clipped to [0, 1], six decimals."""
    kept = F.coalesce(_probability(p), F.lit(fallback))
    return rows.select(F.col(path).alias("image_path"), F.round(F.least(F.greatest(kept, F.lit(0.0)), F.lit(1.0)), 6).alias("pred"))


def predictions_json(rows: DataFrame, path: str, **names) -> None:
    """One JSON object per line, ordered by path."""
    prediction_records(rows, **names).orderBy("image_path").write.json(path)


def prediction_table(rows: DataFrame, branches: list[str], path: str = "image_path", p: str = "pred", threshold: float = 0.5) -> DataFrame:
    """All columns as text: six decimals or NaN, and the verdict."""
    text = lambda c: F.when(_probability(c).isNull(), "NaN").otherwise(F.format_string("%.6f", F.col(c)))
    verdict = F.when(_probability(p).isNull(), "UNREADABLE").when(F.col(p) >= threshold, "FAKE").otherwise("REAL")
    return rows.select(F.col(path).alias("image_path"), text(p).alias("pred"), verdict.alias("verdict"), *[text(b).alias(b) for b in branches])


def predictions_csv(rows: DataFrame, path: str, branches: list[str], **names) -> None:
    prediction_table(rows, branches, **names).write.options(**EXACT).csv(path)


def hash_list(hashes: DataFrame, path: str, comment: str = "") -> None:
    """One hash per line, below its comment."""
    lines = hashes.select(F.col(hashes.columns[0]).alias("value"))
    if comment:
        lines = hashes.sparkSession.createDataFrame([(f"# {c}",) for c in comment.splitlines()], "value string").union(lines)
    lines.write.text(path)


def image_bytes(rows: DataFrame, root: str) -> None:
    """Files of (folder, name, content) below a folder of a file system that all executors share; a file that exists stays."""
    from sievelight.sources.files import write_new

    def write(part):
        for r in part:
            write_new(f"{root}/{r['folder']}/{r['name']}", bytes(r["content"]))

    rows.select("folder", "name", "content").foreachPartition(write)


def append_scores(scores: DataFrame, path: str) -> None:
    """Scores (manifest, model, variant, row_id, score, done) beside those written before; keys are folders."""
    scores.write.mode("append").partitionBy("manifest", "model", "variant").parquet(path)


def append_features(features: DataFrame, path: str) -> None:
    """Vectors (manifest, model, variant, row_id, vector) beside those written before; keys are folders."""
    features.write.mode("append").partitionBy("manifest", "model", "variant").parquet(path)


def markdown(rows: list[dict], columns: list[tuple[str, str]]) -> str:
    """A table as text, for results of a few rows."""
    def cell(v) -> str:
        return "n/a" if v is None or v != v else f"{v:.3f}" if isinstance(v, float) else str(v)

    lines = ["| " + " | ".join(title for _, title in columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(cell(r[key]) for key, _ in columns) + " |" for r in rows]
    return "\n".join(lines)
