"""Quality classifier by compression.

Two zstandard dictionaries are built from pieces of good and of bad labelled texts. A text is compressed piece by piece
with either; the difference of the compressed sizes over the text's own size tells which kind it resembles, and is next to nothing for
a text that only repeats itself, as that shrinks to nothing with either. A logistic curve, fitted on other labelled texts, turns
the difference into a score. Only the fit runs on the driver, on samples of documented size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, table, unused

#: Bound of the fit: so many labelled rows of each class for the dictionaries, and as many for the calibration.
SAMPLE_ROWS = 1500
#: So many pieces of each class go into a dictionary.
SAMPLE_PIECES = 4000
PIECE = 2048
DICT_BYTES = 96 << 10
LEVEL = 3
THRESHOLD = 0.7


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weight: float
    bias: float


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


#: Bytes of an empty frame, which say nothing about the text.
_FRAME = 9


def pieces(text: bytes) -> list[bytes]:
    return [text[a : a + PIECE] for a in range(0, len(text), PIECE)]


def measure(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """How many bytes fewer the whole text takes with the good dictionary than with the bad one, over its own bytes; 0 for an empty
    text."""
    saved = sum(max(1, len(bad.compress(p)) - _FRAME) - max(1, len(good.compress(p)) - _FRAME) for p in pieces(text))
    return saved / len(text) if text else 0.0


def _measures(docs: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """docs (its text as the last column) with the column diff instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, b = _compressor(good), _compressor(bad)
        for batch in batches:
            diff = [measure(t or b"", g, b) for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(diff, pa.float64())], names=[*batch.schema.names[:-1], "diff"])

    *kept, _ = docs.schema.fields
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "diff double"]))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weight and bias of a logistic curve, by Newton steps with a small ridge."""
    scale = float(x.std()) or 1.0
    z = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + 1e-2 * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on labelled rows (label 0 or 1; others count for nothing).

    The rows are chosen by the hash of their id: by turns for the dictionaries and for the calibration, SAMPLE_ROWS of each class
    for either. With one class only, or none, the curve is flat and gives the share of label 1 (0.5 without labels).
    """
    ids = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    turn = F.xxhash64("id", F.lit("quality"))
    firsts = [ids.where(F.col("label") == label).orderBy(turn, "id").limit(2 * SAMPLE_ROWS) for label in (0, 1)]
    place = F.row_number().over(Window.partitionBy("label").orderBy(turn, "id"))  # over the sample only
    chosen = firsts[0].union(firsts[1]).select("id", "label", (place % 2).alias("half"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(chosen), "id")  # 4 * SAMPLE_ROWS ids at most
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / PIECE)).cast("int"))
    cut = rows.where("half = 0").select("id", "label", "text", F.explode(starts).alias("n")).select("id", "label", "n", F.substring("text", F.col("n") * PIECE + 1, F.lit(PIECE)).alias("piece")).where("piece != ''")
    dicts = []
    for label in (1, 0):
        got = cut.where(F.col("label") == label).orderBy(F.xxhash64("id", "n"), "piece").limit(SAMPLE_PIECES).select("piece").collect()
        dicts.append(_dictionary([r.piece.encode() for r in got]))
    other = _measures(rows.where("half = 1").select("label", "text"), *dicts).collect()
    x, y = np.array([r.diff for r in other], float), np.array([r.label for r in other], float)
    sizes = {r.label: r.n for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if 0 < y.sum() < len(y):
        # the sample has other shares of the classes than the labels
        share = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (len(y) - y.sum()))
        slope, bias = _logistic(x, y, share * len(y) / share.sum())
    else:
        mean = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
        mean = min(max(mean, 0.01), 0.99)
        slope, bias = 0.0, float(np.log(mean / (1 - mean)))
    return QualityModel(*dicts, slope, bias)


def _dictionary(samples: list[bytes]) -> bytes:
    """Content of a dictionary, most telling parts last; the samples as they are where they are too few to train on."""
    try:
        trained = zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8, f=20, level=LEVEL, threads=1)
        return trained.as_bytes()
    except zstandard.ZstdError:
        return (b"\n".join(samples))[-DICT_BYTES:] or b"\n" * 8


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, diff, score) of every row; null and empty texts have diff 0 and the score that goes with it."""
    found = _measures(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), model.good, model.bad)
    return found.withColumn("score", _score(model))


def with_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """docs, all rows and columns as they are, with the score as the column out, which must be a new name."""
    if unused(docs, out) != out:
        raise ValueError(f"docs has a column {out} already")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return _measures(rows, model.good, model.bad).select("doc.*", _score(model).alias(out))


def _score(model: QualityModel) -> Column:
    return 1 / (1 + F.exp(-(F.col("diff") * model.weight + F.lit(model.bias))))


def learnable(labels: DataFrame) -> DataFrame:
    """The rows of labels that may be learned from: crc32(doc_id as text) mod 4 is not 2."""
    return labels.where(crc_mod("doc_id", 4) != 2)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, learnable(table(spark, sf_dir, "labels")))
    scored = score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "diff")
