"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's features describe its characters and those of the lines before and after it. Lines take the label of
their document while learning. The marginals of the forward-backward pass, weighted by the lengths of the lines, give the
document's mean, and a logistic step fitted on the same sample turns it into the probability of label 1.

The field has about forty weights and is fitted on a bounded sample: the ``SAMPLE_DOCS`` labelled documents with the smallest
hash of their id, of each at most the documents with ``SAMPLE_LINES`` lines. The features are made in tasks; only those of the sample
reach the driver. Scoring covers every line of every text, each text alone, nothing shuffled.

Odd input: a null or empty text is one empty line; a null key counts as held out; repeated labels of a document count
each; a label that is null is not learned from; without both labels in the sample all scores are 0.5; rows repeat as they
come; other columns pass through, and an output column replaces an input column of its name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainwright.llm.batches import append, by_character
from chainwright.llm.language import held_out

SAMPLE_DOCS, SAMPLE_LINES = 4000, 500
BATCH_CHARS = 1_000_000
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
OWN = 13
WIDTH = 3 * OWN + 3


def _kind(c: str) -> int:
    """0 other, 1 lower, 2 upper, 3 other letter, 4 digit, 5 white space, 6 sentence mark, 7 symbol."""
    if c.isalpha():
        return 1 if c.islower() else 2 if c.isupper() else 3
    if c.isdigit():
        return 4
    if c.isspace():
        return 5
    return 6 if c in ".,;:?'\"()-" else 7


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths with the line end, and the number of lines of each text."""
    # every text ends with a line end, so every line has one
    flat = np.frombuffer("".join([x + "\n" for x in texts]).encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(flat == 10)
    begin = np.r_[0, ends[:-1] + 1]
    lines = np.fromiter((x.count("\n") + 1 for x in texts), np.int64, len(texts))
    kind = by_character(flat, _kind)
    length = (ends - begin + 1).astype(np.float64)
    at = lambda mask: np.add.reduceat(mask.astype(np.float64), begin)
    letters = at((kind >= 1) & (kind <= 3))
    same = np.r_[False, (flat[1:] == flat[:-1]) & (kind[1:] == 7)]
    word = np.r_[True, kind[:-1] == 5] & (kind != 5)
    words = at(word)
    upper, solid = at(kind == 2), np.maximum(length - at(kind == 5), 1)
    # a hash of the line finds repeats of its neighbours
    mixed = (flat.astype(np.uint64) + np.uint64(1)) * (np.arange(len(flat), dtype=np.uint64) - np.repeat(begin, (ends - begin + 1)).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    mixed ^= mixed >> np.uint64(29)
    print_of = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), begin)
    # words that repeat the one before, by a hash of their characters
    heads = np.flatnonzero(word)
    if len(heads):
        inside = np.arange(len(flat)) - heads[np.maximum(np.cumsum(word) - 1, 0)]
        signs = np.where(kind == 5, 0, (flat.astype(np.uint64) + np.uint64(7)) * (inside.astype(np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)))
        code = np.add.reduceat(signs ^ (signs >> np.uint64(31)), heads)
        again = np.zeros(len(flat), bool)
        again[heads[1:][code[1:] == code[:-1]]] = True
    else:
        again = np.zeros(len(flat), bool)
    last = np.maximum(ends - 1, begin)
    own = np.stack(
        [
            np.log1p(length) / 5,
            letters / solid,
            upper / np.maximum(letters, 1),
            at(kind == 4) / solid,
            at(kind == 6) / solid,
            at(kind == 7) / solid,
            at(same) / solid,
            np.minimum(solid / np.maximum(words, 1), 20) / 10,
            (at(flat == 33) / np.maximum(words, 1)).clip(0, 2),
            (at(kind == 7) / np.maximum(words, 1)).clip(0, 2),
            (flat[last] == 46).astype(np.float64),
            np.log1p(words) / 5,
            at(again) / np.maximum(words, 1),
        ],
        1,
    )
    first = np.zeros(len(begin), bool)
    first[np.r_[0, np.cumsum(lines)[:-1]]] = True
    final = np.r_[first[1:], True]
    before = np.where(first[:, None], 0, np.roll(own, 1, 0))
    after = np.where(final[:, None], 0, np.roll(own, -1, 0))
    twin = (~first & (print_of == np.roll(print_of, 1))) | (~final & (print_of == np.roll(print_of, -1)))
    extra = np.stack([np.ones(len(begin)), twin.astype(np.float64), (first & final).astype(np.float64)], 1)
    return np.hstack([own, before, after, extra]), length, lines


@dataclass
class Model:
    """Weights of the lines' features, 2 x 2 transition weights, and the logistic step on the mean marginal."""

    unary: np.ndarray
    moves: np.ndarray
    slope: float
    offset: float


def _soft(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def forward_backward(unary: np.ndarray, moves: np.ndarray, lines: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Probability of "good" for every line, and the expected number of each move in each text if asked for.

    Texts are processed side by side, longest first: a step handles the lines at one place of all texts that reach it.
    """
    start = np.r_[0, np.cumsum(lines)[:-1]]
    order = np.argsort(-lines, kind="stable")
    begin, size = start[order], lines[order]
    reach = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right") if len(size) else []
    state = np.stack([np.zeros(len(unary)), unary], 1)
    alpha, beta = state.copy(), np.zeros_like(state)
    for t in range(1, len(reach)):
        i = begin[: reach[t]] + t
        alpha[i] += _soft(alpha[i - 1][:, :, None] + moves[None], 1)
    for t in range(len(reach) - 2, -1, -1):
        i = begin[: reach[t + 1]] + t
        beta[i] = _soft(moves[None] + (state[i + 1] + beta[i + 1])[:, None, :], 2)
    both = alpha + beta
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    if not pairs:
        return good, None
    inner = np.ones(len(unary), bool)
    inner[start] = False
    i = np.flatnonzero(inner)
    joint = alpha[i - 1][:, :, None] + moves[None] + (state[i] + beta[i])[:, None, :]
    joint = np.exp(joint - _soft(both[i], 1)[:, None, None])
    text = np.repeat(np.arange(len(lines)), lines)[i]
    return good, np.stack([np.bincount(text, joint[:, a, b], len(lines)) for a in (0, 1) for b in (0, 1)], 1).reshape(-1, 2, 2)


def document_mean(good: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
    start = np.r_[0, np.cumsum(lines)[:-1]]
    return np.add.reduceat(good * length, start) / np.add.reduceat(length, start)


def learn(features: np.ndarray, length: np.ndarray, lines: np.ndarray, label: np.ndarray) -> Model:
    """Fit the field by gradient steps (Adam) on the mean log-likelihood per line, both labels weighing the same, then the logistic step."""
    text = np.repeat(np.arange(len(lines)), lines)
    balance = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9)) / lines
    weight = (balance / len(lines))[text]
    target = label[text].astype(np.float64)
    seen = np.zeros((len(lines), 2, 2))
    seen[np.arange(len(lines)), label, label] = lines - 1
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, STEPS + 1):
        good, moved = forward_backward(features @ theta[:WIDTH], theta[WIDTH:].reshape(2, 2), lines, True)
        gradient = np.r_[features.T @ (weight * (target - good)), ((seen - moved) * (balance / len(lines))[:, None, None]).sum(0).ravel()] - RIDGE * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    unary, moves = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
    mean = document_mean(forward_backward(features @ unary, moves, lines)[0], length, lines)
    x, slope, offset = _logit(mean), 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridge-regularised logistic regression with one input
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        g = np.array([((label - p) * x).sum() - 1e-2 * slope, (label - p).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum()]])
        slope, offset = np.array([slope, offset]) + np.clip(np.linalg.solve(h, g), -1, 1)
    return Model(unary, moves, float(slope), float(offset))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE_DOCS) -> Model | None:
    """Learn from a bounded sample of the labelled documents; None if it lacks one of the labels 0 and 1."""
    chosen = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).alias("_label")).orderBy(F.xxhash64(F.col(key).cast("string")), key, "_label").limit(sample)
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).join(chosen, key).select("_label", "_text")
    fields = [T.StructField("features", T.BinaryType()), T.StructField("length", T.BinaryType()), T.StructField("n", T.IntegerType())]

    def work(values: pa.Array) -> list[pa.Array]:
        made = []
        for x in values.to_pylist():
            f, length, lines = line_features([x]) if x.count("\n") < SAMPLE_LINES else (np.zeros((0, WIDTH)), np.zeros(0), [0])
            made.append((f.astype(np.float32).tobytes(), length.astype(np.float32).tobytes(), int(lines[0])))
        return [pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.binary(), pa.binary(), pa.int32()), strict=True)]

    got = append(rows, "_text", fields, work, BATCH_CHARS).select("_label", "features", "length", "n").where("n > 0").limit(sample).collect()
    got.sort(key=lambda r: (r["n"], bytes(r["features"]), r["_label"]))
    target = np.array([r["_label"] for r in got], np.int64)
    if len(set(target.tolist())) < 2:
        return None
    features = np.concatenate([np.frombuffer(r["features"], np.float32) for r in got]).reshape(-1, WIDTH).astype(np.float64)
    length = np.concatenate([np.frombuffer(r["length"], np.float32) for r in got]).astype(np.float64)
    return learn(features, length, np.array([r["n"] for r in got], np.int64), target)


def score(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``score`` and ``line_scores`` (probability of each line to be good)."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("line_scores", T.ArrayType(T.FloatType()))]

    def work(values: pa.Array) -> list[pa.Array]:
        features, length, lines = line_features([x or "" for x in values.to_pylist()])
        at = pa.array(np.r_[0, np.cumsum(lines)].astype(np.int32))
        if model is None:
            return [pa.array(np.full(len(values), 0.5)), pa.ListArray.from_arrays(at, pa.array(np.full(len(length), 0.5, np.float32)))]
        good, _ = forward_backward(features @ model.unary, model.moves, lines)
        whole = 1 / (1 + np.exp(-(model.slope * _logit(document_mean(good, length, lines)) + model.offset)))
        return [pa.array(whole), pa.ListArray.from_arrays(at, pa.array(good.astype(np.float32)))]

    return append(df, text, fields, work, BATCH_CHARS)


def op8_quality(spark, folder: str) -> DataFrame:
    """The quality of every text of ``documents``, learned from two thirds of the labels."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", "quality")
    model = fit(docs, labels)
    scored = score(docs.withColumn("held_out", held_out(F.col("doc_id"), 3, 1)), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
