"""Byte-pair encoding and decoding of whole texts with batched numpy merge rounds.

The words of a batch of texts lie in one flat array of symbols. Each round looks up the ranks of all neighbouring pairs
by binary search over the sorted pair keys, finds the lowest rank of every word, and merges its pairs from left to
right; words without a known pair leave the array. Equal words are encoded once per batch. That all pairs of the lowest
rank may merge at once needs merges that build only on earlier ones; the loader checks it.

The vocabulary file is read on the driver, where its path is a parameter, and sent with the task; it does not grow with
the data. Each row is encoded alone, so nothing is shuffled; batches are cut by characters, so memory is bounded by
the longest text.

Odd input: a null text is encoded as an empty one and gives no ids; special tokens inside a text become their ids;
ids that the vocabulary lacks, and null ids, are dropped when decoding, as is a null list; other columns pass through.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainwright.llm.batches import append
from chainwright.llm.common import hex_digest

#: Characters of text in one numpy batch.
BATCH_CHARS = 500_000
#: Words whose ids a task keeps for later batches.
CACHE_WORDS = 100_000
NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable bytes for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


@dataclass
class Tables:
    """A vocabulary as arrays; picklable, so that tasks get it ready made."""

    tokens: list[str]
    first: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    special: dict[str, int]
    source: str
    splitter: object = field(default=None, repr=False)
    strict: object = field(default=None, repr=False)
    named: np.ndarray | None = None
    arrow: pa.Array | None = field(default=None, repr=False)
    cache: dict = field(default_factory=dict, repr=False)

    def named_tokens(self) -> pa.Array:
        if self.arrow is None:
            self.arrow = pa.array(self.tokens, pa.string())
        return self.arrow


def load(path: str) -> Tables:
    """Read a tokenizer file of lower-casing byte-pair words with word ends."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
    vocab = dict(model["vocab"])
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
    for t, i in [*vocab.items(), *special.items()]:
        tokens[i] = t
    signs = byte_symbols()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int64)
    born = np.full(len(tokens), -1, np.int64)
    born[made[::-1]] = np.arange(len(made))[::-1]  # the first merge that makes a token
    rank = np.arange(len(pairs))
    if not ((born[left] < rank) & (born[right] < rank)).all():
        raise ValueError("a merge builds on a later one; pairs of one rank may not be merged at once")
    keys = left * len(tokens) + right
    order = np.argsort(keys, kind="stable")
    last = [vocab[c + suffix] for c in signs] if suffix else [vocab[c] for c in signs]
    return Tables(tokens, np.array([vocab[c] for c in signs], np.int64), np.array(last, np.int64), keys[order], rank[order], made[order], special, text, named=np.array([t != "" for t in tokens]))


def _prepare(t: Tables) -> None:
    letters = "".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == "L")
    numbers = "".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == "N")
    t.splitter = re.compile(rf"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^\s{letters}{numbers}]+")
    from tokenizers import Tokenizer

    t.strict = Tokenizer.from_str(t.source)


#: Anything else than white space, printable ASCII, Latin-1 and Latin Extended-A takes the slow path.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ſ]")
_SIGN_BYTES = {c: b for b, c in enumerate(byte_symbols())}


def split_words(t: Tables, text: str) -> list[str | bytes | int]:
    """Words of a text, and ids of the special tokens in it.

    Unusual characters are normalised and split by the tokenizer's own tables of characters.
    """
    if t.splitter is None:
        _prepare(t)
    parts = re.split("(" + "|".join(map(re.escape, t.special)) + ")", text) if t.special and "<|" in text else [text]
    out: list[str | bytes | int] = []
    for part in parts:
        if part in t.special:
            out.append(t.special[part])
        elif UNUSUAL.search(part):
            pieces = t.strict.pre_tokenizer.pre_tokenize_str(t.strict.normalizer.normalize_str(part))
            out += [bytes(_SIGN_BYTES[c] for c in piece) for piece, _ in pieces]
        else:
            out += t.splitter.findall(part.lower())
    return out


def merge(t: Tables, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array and the offset of each word in it."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    sym = t.first[flat]
    end = np.cumsum(n)
    sym[end - 1] = t.last[flat[end - 1]]
    word = np.repeat(np.arange(len(words)), n)
    size = len(t.tokens)
    finished: list[tuple[np.ndarray, np.ndarray]] = []
    while len(sym):
        key = sym[:-1] * size + sym[1:]
        at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
        known = (t.keys[at] == key) & (word[:-1] == word[1:])
        rank = np.full(len(sym), NONE)
        rank[:-1][known] = t.ranks[at[known]]
        begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lowest = np.minimum.reduceat(rank, begin)
        per = np.repeat(lowest, np.diff(np.r_[begin, len(sym)]))
        done = per == NONE
        hit = (rank == per) & ~done
        # of overlapping hits (a a a) the first, third, ... count
        where = np.flatnonzero(hit)
        run = np.r_[True, np.diff(where) > 1] if len(where) else np.zeros(0, bool)
        since = np.arange(len(where)) - np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
        where = where[since % 2 == 0]
        sym[where] = t.merged[at[where]]
        keep = ~done
        keep[where + 1] = False
        if done.any():
            finished.append((word[done], sym[done]))
        sym, word = sym[keep], word[keep]
    which = np.concatenate([w for w, _ in finished]) if finished else np.zeros(0, np.int64)
    ids = np.concatenate([s for _, s in finished]) if finished else np.zeros(0, np.int64)
    order = np.argsort(which, kind="stable")
    return ids[order].astype(np.int32), np.r_[0, np.cumsum(np.bincount(which, minlength=len(words)))]


def encode_batch(t: Tables, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array and the offsets of the texts."""
    cuts = [split_words(t, x) for x in texts]
    place: defaultdict[str | bytes | int, int] = defaultdict()
    place.default_factory = place.__len__
    count = np.fromiter(map(len, cuts), np.int64, len(cuts))
    index = np.fromiter(map(place.__getitem__, chain.from_iterable(cuts)), np.int64, int(count.sum()))
    place.default_factory = None
    fresh = [w for w in place if w not in t.cache]
    if fresh:
        if len(t.cache) + len(fresh) > CACHE_WORDS:
            t.cache.clear()
            fresh = list(place)
        t.cache.update((w, np.array([w], np.int32)) for w in fresh if isinstance(w, int))
        fresh = [w for w in fresh if not isinstance(w, int)]
        ids, at = merge(t, [w.encode() if isinstance(w, str) else w for w in fresh])
        cut = at.tolist()
        t.cache.update((w, ids[a:b]) for w, a, b in zip(fresh, cut[:-1], cut[1:], strict=True))
    each = list(map(t.cache.__getitem__, place))
    lengths = np.fromiter(map(len, each), np.int64, len(each))
    flat = np.concatenate(each) if each else np.zeros(0, np.int32)
    begin = np.r_[0, np.cumsum(lengths)][:-1]
    taken = lengths[index]
    out_end = np.cumsum(taken)
    ids = flat[np.repeat(begin[index] - (out_end - taken), taken) + np.arange(int(taken.sum()))] if len(index) else np.zeros(0, np.int32)
    return ids, np.r_[0, np.r_[0, out_end][np.cumsum(count)]]


def decode_lists(t: Tables, ids: pa.ListArray) -> pa.Array:
    """The tokens of each list joined by spaces, as the file names no decoder."""
    size = np.array(pc.list_value_length(ids).fill_null(0), np.int64)
    flat = np.array(ids.flatten().fill_null(-1), np.int64)
    good = (flat >= 0) & (flat < len(t.tokens))
    good[good] = t.named[flat[good]]
    end = np.r_[0, np.cumsum(good)][np.r_[0, np.cumsum(size)]]
    words = t.named_tokens().take(pa.array(flat[good]))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(end.astype(np.int32)), words), " ")


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add ``ids``, the token ids of the whole text, and, if named, ``decoded``, the text that these ids decode to."""
    tables = load(path)
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]

    def work(values: pa.Array) -> list[pa.Array]:
        flat, at = encode_batch(tables, [x or "" for x in values.to_pylist()])
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
        return [lists, *([decode_lists(tables, lists)] if decoded else [])]

    return append(df, text, fields, work, BATCH_CHARS)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``: the tokens of the ids, special tokens included."""
    tables = load(path)
    return append(df, ids, [T.StructField(text, T.StringType())], lambda values: [decode_lists(tables, values.cast(pa.list_(pa.int32())))], BATCH_CHARS)


def op5_bpe(spark, folder: str) -> DataFrame:
    """Encode every text of ``documents`` and decode the ids again."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    done = encode(docs, path, decoded="decoded")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex_digest(F.array_join("ids", " ")).alias("ids_sha256"),
        hex_digest(F.col("decoded")).alias("decoded_sha256"),
    )
