"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document of n tokens is cut into pieces of ``longest`` tokens and then into one piece for each binary digit of the rest, longest
first. A piece is a sequence of its own. Sequences of one length form a bucket, so a batch drawn from a bucket has one shape; all lengths are
powers of two, so there is nothing to pad.

Token ids are those of a byte-level pair encoding whose file is read on the driver, where its path is a parameter. Each text is encoded
alone in Arrow batches cut by bytes, so nothing is shuffled and memory is bounded by the longest text. A sequence number holds
the task and the place of the piece in it, so it is unique however many tasks are run again.

Odd input: a null text is encoded as an empty one, which has only the closing id; repeated rows and rows of one id are packed each for itself; a null
id stays null; the name of a special token inside a text becomes its id; an empty table gives no pieces; columns that are not named as key are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainwright.llm.batches import sizes_of, slices
from chainwright.llm.bpe import byte_symbols

LONGEST = 1024
#: The id that closes every document.
END = 0
BATCH_BYTES = 1_000_000
#: The pattern by which byte-level pair encodings of this family cut a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Ranks of byte strings and special tokens of a file; the encoder is made in each task."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        value = {c: b for b, c in enumerate(byte_symbols())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.ranks = {bytes(value[c] for c in t): i for t, i in vocab.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if spec["normalizer"] or spec["pre_tokenizer"].get("add_prefix_space") or made != sorted(set(made)):
            raise ValueError("ids must rise with the merges of a byte-level file without normaliser")
        self.made = None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def encode(self, text: str) -> np.ndarray:
        if self.made is None:
            import tiktoken

            self.made = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        return self.made.encode_to_numpy(text, allowed_special="all")


def cut(tokens: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, start and length of all pieces of documents of so many tokens."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    powers = longest >> np.arange(longest.bit_length())
    # how often each length occurs in each document: whole pieces first, then one per digit of the rest
    times = np.concatenate([tokens[:, None] // longest, (tokens[:, None] & powers[1:]) > 0], 1).astype(np.int64)
    doc = np.repeat(np.arange(len(tokens)), times.sum(1))
    length = np.repeat(np.tile(powers, len(tokens)), times.ravel())
    before = np.cumsum(length) - length
    return doc, before - np.r_[0, np.cumsum(tokens)][doc], length


def pieces(docs: DataFrame, path: str, keys: Sequence[str] = ("doc_id",), text: str = "text", longest: int = LONGEST, end: int = END) -> DataFrame:
    """One row per piece: the keys, ``start``, ``length``, ``doc_tokens`` and ``ids``, its ids as little-endian unsigned 32-bit numbers."""
    vocabulary, many = Vocabulary(path), len(keys)
    made = [T.StructField(x, T.LongType()) for x in ("start", "length", "doc_tokens")] + [T.StructField("ids", T.BinaryType())]
    schema = T.StructType([*[T.StructField(f"k{i}", docs.schema[k].dataType) for i, k in enumerate(keys)], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in slices(sizes_of(b.column(many)), BATCH_BYTES):
                closing = np.array([end], np.uint32)
                parts = [p for x in b.column(many).slice(a, z - a).to_pylist() for p in (vocabulary.encode(x or ""), closing)]
                tokens = np.fromiter(map(len, parts), np.int64, len(parts)).reshape(-1, 2).sum(1)
                doc, start, length = cut(tokens, longest)
                flat = np.concatenate(parts).astype("<u4")
                bounds = np.r_[0, np.cumsum(length) * 4].astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(flat.tobytes())])
                which = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(i).slice(a, z - a).take(which) for i in range(many)], pa.array(start), pa.array(length), pa.array(tokens[doc]), ids], schema.names
                )

    named = [docs[k].alias(f"k{i}") for i, k in enumerate(keys)]
    return docs.select(*named, docs[text].alias("_text")).mapInArrow(run, schema).toDF(*keys, *[f.name for f in made])


def pack(docs: DataFrame, path: str, keys: Sequence[str] = ("doc_id",), text: str = "text", longest: int = LONGEST, end: int = END) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: each is a sequence of its own, of the bucket of its length."""
    return pieces(docs, path, keys, text, longest, end).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the sequences as Parquet, one folder for each length."""
    packed.write.partitionBy("length").parquet(path)


def op12_packing(spark, folder: str) -> DataFrame:
    """Sequences of at most 1,024 tokens of every text of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    packed = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
