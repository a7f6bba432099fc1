"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of one word (a maximal run without ASCII white space, its ends marked) of whatever length from
both sides and gives every position a distribution over the languages. A document's distribution is the mean over all
positions of all its words that hold a letter. Words are independent sequences, so a batch of documents runs the network
once for each distinct word and weighs it by its count: whole texts at a fraction of the work, with the same result.

Training is backpropagation through time in numpy with Adam, on the driver, on a sample of words of documented size; words
longer than SPAN are learned from in parts, as gradients that go farther back are of no use.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORDS, crc_mod, table

#: Bounds of the fit: documents, and distinct words of them.
SAMPLE_DOCS = 3000
SAMPLE_WORDS = 60_000
EPOCHS = 4
BATCH = 256
HIDDEN = 16
EMBED = 12
RATE = 0.01
#: Bytes that gradients go back at most in training. Predictions read words whole.
SPAN = 48
UNDETERMINED = "und"
#: Words of one run of the network, and positions of all of them together.
GROUP = 4096
POSITIONS = 1 << 19
_WORDY = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _start(n_languages: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {"embed": rng.normal(0, 0.3, (256, EMBED)), "out": rng.normal(0, 0.3, (2 * HIDDEN, n_languages)), "out_b": np.zeros(n_languages)}
    for side in "fb":
        w |= {f"{side}_x": rng.normal(0, 0.3, (EMBED, 3 * HIDDEN)), f"{side}_h": rng.normal(0, 0.25, (HIDDEN, 3 * HIDDEN)), f"{side}_b": np.zeros(3 * HIDDEN)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def _forward(w: dict[str, np.ndarray], x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
    """States after each position of x (words, length), in order of position; side b reads from the end.

    Update z, reset r, candidate c: h' = z h + (1 - z) c, where c sees r * (h U_c). keep gets what the way back needs.
    """
    n, length = x.shape
    inputs = w["embed"] @ w[f"{side}_x"] + w[f"{side}_b"]  # one row for each byte value
    h = np.zeros((n, HIDDEN), np.float32)
    states = np.empty((length, n, HIDDEN), np.float32)
    for t in range(length) if side == "f" else range(length - 1, -1, -1):
        a, u = inputs[x[:, t]], h @ w[f"{side}_h"]
        gates = _sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((t, h, z, r, c, u[:, 2 * HIDDEN :]))
        h = z * h + (1 - z) * c
        states[t] = h
    return states


def position_probabilities(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """(length, words, languages): the distribution at every position."""
    s = _forward(w, x, "f") @ w["out"][:HIDDEN] + _forward(w, x, "b") @ w["out"][HIDDEN:] + w["out_b"]
    s = np.exp(s - s.max(-1, keepdims=True))
    return s / s.sum(-1, keepdims=True)


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over all positions and its gradients, by backpropagation through time."""
    n, length = x.shape
    kept: dict[str, list] = {"f": [], "b": []}
    states = {side: _forward(w, x, side, kept[side]) for side in "fb"}
    s = states["f"] @ w["out"][:HIDDEN] + states["b"] @ w["out"][HIDDEN:] + w["out_b"]
    p = np.exp(s - s.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    loss = float(-np.log(p[:, np.arange(n), y] + 1e-9).mean())
    ds = p
    ds[:, np.arange(n), y] -= 1
    ds /= n * length
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["out_b"] = ds.sum((0, 1))
    for side, at in (("f", slice(HIDDEN)), ("b", slice(HIDDEN, None))):
        g["out"][at] = np.einsum("tnh,tnk->hk", states[side], ds)
        back = ds @ w["out"][at].T
        inputs = np.zeros((256, 3 * HIDDEN), np.float32)
        dh = np.zeros((n, HIDDEN), np.float32)
        for t, h, z, r, c, uc in reversed(kept[side]):
            dh = dh + back[t]
            dc = dh * (1 - z) * (1 - c * c)
            da = np.concatenate([dh * (h - c) * z * (1 - z), dc * uc * r * (1 - r), dc], 1)
            du = np.concatenate([da[:, : 2 * HIDDEN], dc * r], 1)
            np.add.at(inputs, x[:, t], da)
            g[f"{side}_h"] += h.T @ du
            dh = dh * z + du @ w[f"{side}_h"].T
        g[f"{side}_x"] = w["embed"].T @ inputs
        g[f"{side}_b"] = inputs.sum(0)
        g["embed"] += inputs @ w[f"{side}_x"].T
    return loss, g


def has_letter(word: str) -> bool:
    """Whether a character of the Unicode categories L stands in the word; the pattern is wider, but quick."""
    return any(unicodedata.category(m[0])[0] == "L" for m in _WORDY.finditer(word))


def marked(word: bytes) -> bytes:
    """A word with its ends marked by spaces."""
    return b" " + word + b" "


def _by_length(parts: list[bytes]) -> Iterator[np.ndarray]:
    """Numbers of parts of one length, GROUP and POSITIONS at most at once."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    order = np.argsort(lengths, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        step = max(1, min(GROUP, POSITIONS // max(1, int(lengths[same[0]])))) if len(same) else 1
        for a in range(0, len(same), step):
            yield same[a : a + step]


def _matrix(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), -1)


def train(words: list[bytes], labels: list[str], epochs: int = EPOCHS, seed: int = 5) -> LanguageModel:
    """Fit the network on words, each with its document's language. Without words the model knows no language."""
    languages = tuple(sorted(set(labels)))
    rng = np.random.default_rng(seed)
    w = _start(max(1, len(languages)), rng)
    if not languages:
        return LanguageModel((), w)
    parts, y = [], []
    for word, label in zip(words, labels, strict=True):
        whole = marked(word)
        for a in range(0, len(whole), SPAN):
            parts.append(whole[a : a + SPAN])
            y.append(languages.index(label))
    y = np.array(y)
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    groups = list(_by_length(parts))
    batches = [part for g in groups for part in np.array_split(rng.permutation(g), max(1, len(g) // BATCH))]
    total = epochs * len(batches)
    for _ in range(epochs):
        for i in rng.permutation(len(batches)):
            rows = batches[i]
            _, g = _gradients(w, _matrix([parts[j] for j in rows]), y[rows])
            step += 1
            rate = RATE * min(1.0, len(rows) / 64) * (1 - 0.95 * step / total)
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return LanguageModel(languages, w)


def word_sums(model: LanguageModel, words: list[bytes]) -> np.ndarray:
    """(words, languages + 1): the summed distributions over the positions of each word, and their number; zeros for
    words without a letter."""
    out = np.zeros((len(words), len(model.languages) + 1), np.float64)
    parts, of = [], []
    for i, word in enumerate(words if model.languages else []):
        if has_letter(word.decode("utf-8", "replace")):
            parts.append(marked(word))
            of.append(i)
    of = np.array(of, np.int64)
    for rows in _by_length(parts):
        p = position_probabilities(model.weights, _matrix([parts[j] for j in rows]))
        np.add.at(out, of[rows], np.concatenate([p.sum(0), np.full((len(rows), 1), len(p))], 1))
    return out


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on the rows of docs that have a text and a language, SAMPLE_DOCS of them by the hash of their id at most, and
    on SAMPLE_WORDS of their words by the hash of word and id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null and id is not null")
    turn = F.xxhash64("id", F.lit("language"))
    ids = rows.select("id", "lang").orderBy(turn, "id", "lang").limit(SAMPLE_DOCS).select("id").distinct()
    words = rows.join(F.broadcast(ids), "id").select("id", "lang", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({WORDS})")))).alias("word"))
    got = words.where(F.col("word").rlike("\\p{L}")).repartition(4).orderBy(F.xxhash64("word", "id"), "word", "id", "lang").limit(SAMPLE_WORDS).select("word", "lang").collect()
    return train([r.word.encode() for r in got], [r.lang for r in got])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_positions) of every row's whole text.

    score is the pooled probability of lang_pred. Texts that are null or hold no letter are ``und`` with score 0 and no
    positions, as is every text where the model knows no language. Ties go to the language that sorts first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index: dict[bytes, int] = {}
            rows, cols, counts = [], [], []
            for i, t in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                c = Counter((t or b"").split())
                cols.append(np.fromiter((index.setdefault(x, len(index)) for x in c), np.int64, len(c)))
                counts.append(np.fromiter(c.values(), np.float64, len(c)))
                rows.append(np.full(len(c), i, np.int64))
            sums = word_sums(model, list(index))
            k = len(model.languages)
            rows, cols, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols, counts))
            total = np.stack([np.bincount(rows, counts * sums[cols, j], b.num_rows) for j in range(k + 1)], 1) if k else np.zeros((b.num_rows, 1))
            n = total[:, -1]
            best = total[:, :k].argmax(1) if k else np.zeros(b.num_rows, np.int64)
            score = [float(min(1.0, total[i, j] / n[i])) if n[i] else 0.0 for i, j in enumerate(best)]
            lang = [model.languages[j] if n[i] else UNDETERMINED for i, j in enumerate(best)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n.astype(np.int64), pa.int64())], names=["doc_id", "lang_pred", "score", "n_positions"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, n_positions long")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    found = identify(docs, fit_language(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_positions")
