"""Language ID: each document is a mixture of languages, fitted by expectation-maximisation.

Training counts the letter trigrams of every labelled text, in hashed slots: each task adds up one count per language
and slot, so what is shuffled grows with tasks, not texts. The units of the mixture are words: the likelihood of a word
in a language is the product over its letters' trigrams. EM estimates the proportions of a document's languages; of
the nested sets of its likeliest languages the one with the best penalised likelihood is chosen.

The model has ``SLOTS`` floats per language. Label values are expected to be language codes: more than
``MAX_LANGUAGES`` of them raise an error before anything is collected.

Odd input: a null text, an empty one and one without letters are ``und`` with score 0, as is every text when nothing
could be learned; a null key counts as held out; rows repeat as they come; ties go to the language that sorts first; other columns
pass through, and an output column replaces an input column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainwright.llm.batches import append, by_character, sizes_of, slices

SLOTS = 1 << 15
MAX_LANGUAGES = 256
ROUNDS = 15
#: Log-likelihood that one more language must gain, times the log of the number of words.
PENALTY = 3.0
SMOOTHING = 0.5
BATCH_CHARS = 250_000
UNKNOWN = "und"


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every letter of all texts: its text, whether a word begins with it, and the slot of the trigram around it."""
    flat = np.frombuffer("".join(["\0" + x.lower() + "\0" for x in texts]).encode("utf-32-le"), np.uint32)
    code = np.where(by_character(flat, str.isalpha), flat, 0)
    lengths = np.fromiter((len(x.lower()) + 2 for x in texts), np.int64, len(texts))
    at = np.flatnonzero(code)
    mixed = code[at - 1] * np.uint32(0x9E3779B1) + code[at] * np.uint32(0x85EBCA77) + code[at + 1] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    mixed ^= mixed >> np.uint32(13)
    return np.repeat(np.arange(len(texts)), lengths)[at], code[at - 1] == 0, (mixed & np.uint32(SLOTS - 1)).astype(np.int64)


@dataclass
class Model:
    """Log-probability of each slot in each language."""

    languages: list[str]
    logp: np.ndarray


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows with a language and a text."""
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            for a, z in slices(sizes_of(b.column(1)), BATCH_CHARS):
                langs = np.array(b.column(0).slice(a, z - a).to_pylist(), dtype=object)
                doc, _, slot = trigrams(b.column(1).slice(a, z - a).to_pylist())
                for name in set(langs):
                    mine = (langs == name)[doc]
                    totals[name] = totals.get(name, 0) + np.bincount(slot[mine], minlength=SLOTS)
        for name, counts in totals.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used])], ["lang", "slot", "n"])

    counted = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = counted.toArrow()
    counts = np.zeros((SLOTS, len(languages)))
    counts[np.array(found["slot"], np.int64), np.searchsorted(languages, found["lang"].to_pylist())] = np.array(found["n"])
    return Model(languages, np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * SLOTS)).astype(np.float32))


def _em(like: np.ndarray, weight: np.ndarray, doc: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document; ``like`` is scaled to a largest value of 1 per word."""
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    total = np.add.reduceat(weight, begin)[:, None]
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        part = like * share[doc] + 1e-300
        part *= (weight / part.sum(1))[:, None]
        share = np.where(allowed, np.add.reduceat(part, begin) / total, 0)
    fit_of = np.add.reduceat(np.log((like * share[doc]).sum(1) + 1e-300), begin)
    return share, fit_of


def mixture(model: Model, texts: list[str]) -> np.ndarray:
    """Proportions of the chosen language set of each text, all zero where a text has no letters."""
    out = np.zeros((len(texts), len(model.languages)))
    doc, first, slot = trigrams(texts)
    if not len(doc) or not model.languages:
        return out
    begin = np.flatnonzero(first)
    scores = np.add.reduceat(model.logp[slot], begin).astype(np.float64)
    word_doc = doc[begin]
    there, dense = np.unique(word_doc, return_inverse=True)
    like = np.exp(scores - scores.max(1, keepdims=True))
    letters = np.diff(np.r_[begin, len(slot)]).astype(np.float64)
    everything = np.ones((len(there), len(model.languages)), bool)
    share, _ = _em(like, letters, dense, everything)
    order = np.argsort(-share, 1, kind="stable")
    words = np.bincount(dense)
    best = np.full(len(there), -np.inf)
    chosen = np.zeros_like(share)
    active = np.arange(len(there))
    for k in range(1, len(model.languages) + 1):
        mask = np.isin(dense, active)
        _, local = np.unique(dense[mask], return_inverse=True)
        allowed = np.zeros((len(active), len(model.languages)), bool)
        np.put_along_axis(allowed, order[active, :k], True, 1)
        tried, fitted = _em(like[mask], letters[mask], local, allowed)
        gain = fitted - PENALTY * (k - 1) * np.log(words[active] + 1)
        better = gain > best[active]
        best[active[better]] = gain[better]
        chosen[active[better]] = tried[better]
        active = active[better]
        if not len(active):
            break
    out[there] = chosen
    return out


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (its proportion) and ``languages`` (proportions of the chosen set)."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.MapType(T.StringType(), T.DoubleType()))]
    limit = max(10_000, 4 * BATCH_CHARS // max(4, len(model.languages)))

    def work(values: pa.Array) -> list[pa.Array]:
        shares = np.clip(mixture(model, [x or "" for x in values.to_pylist()]), 0, 1)
        top = shares.argmax(1) if shares.shape[1] else np.zeros(len(values), int)
        score = shares.max(1) if shares.shape[1] else np.zeros(len(values))
        names = [model.languages[i] if s > 0 else UNKNOWN for i, s in zip(top, score, strict=True)]
        sets = [[(model.languages[i], float(row[i])) for i in np.flatnonzero(row > 0)] for row in shares]
        return [pa.array(names, pa.string()), pa.array(score), pa.array(sets, pa.map_(pa.string(), pa.float64()))]

    return append(df, text, fields, work, limit)


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether the checksum of a key falls into the part that is not learned from; a null key does."""
    return F.coalesce(F.crc32(key.cast("string")) % parts == part, F.lit(True))


def op6_language_id(spark, folder: str) -> DataFrame:
    """The language of every text of ``documents``, learned from three quarters of them."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")
