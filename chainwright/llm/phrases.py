"""Phrase collocations: best-first branch and bound over phrases of two and three words, counted exactly.

A phrase with a occurrences has no part with fewer, so a word, or a prefix, with few or with far too many occurrences bounds the score of every phrase grown
from it: two words of f1 and f2 occurrences score at most min / max of them, three at most min(f1, f2, f3) / max(f1, f3). The frontier
is expanded in bands of that bound, best first:

1. All words are counted. A table of ``slots`` of words, with the range of counts in each slot, goes to the tasks; its size is bounded, and where words
   share a slot the bound only becomes weaker.
2. In a round, occurrences whose bound reaches the threshold are grown to phrases and counted; counts then give exact scores of pairs and
   tighter bounds (a / f1, a / f3) of triples.
3. A second pass counts what these still need: the pairs inside triples, and every triple around a pair that scores high enough, since
   one that is frequent enough takes the pair's place. A bit table of bounded size finds the occurrences; sums are joined exactly.
4. A language is settled when ``top`` phrases at or above the threshold survive, ties included; the others go on with a lower threshold,
   chosen by what the round found, down to 0.

Occurrences are added up in each batch before the shuffle, so a hot word or pair costs one row per batch. Words are 64-bit hashes of text and language; the count of words
finds two words of one hash, and then all is done anew with another seed, so counts are exact.

Odd input: a null text has no words, a null language is ``und``; a text without words adds nothing; repeated rows count each; words may be of any length;
other columns are not read; an empty table gives no phrases.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainwright.llm.batches import sizes_of, slices
from chainwright.llm.shingles import mix
from chainwright.operators.order import positions, spread
from chainwright.session import stash

LEAST, TOP, SHARE = 10, 2_000, 50
MILLION = 1_000_000
#: Threshold of the first round, in millionths, and the threshold below which the next one is 0.
FIRST, LAST = 500_000, 1_000
#: Bounds of the tables that go to tasks: word slots, and bits of pairs.
MOST_SLOTS, MOST_BITS = 1 << 22, 1 << 26
#: Steps of a count class per doubling.
STEPS = 64
BATCH_BYTES = 2_000_000
#: Distinct words a task holds before it passes them on.
HELD = 300_000
SALTS = 64
UNKNOWN = "und"
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def scan(langs: list[str], texts: list[str], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """For every word of all texts: its hash, its piece, its text's number, and where it begins and ends in the joined bytes."""
    raw = [x.encode("utf-8", "surrogatepass") + b"\n" for x in texts]
    joined = b"".join(raw).lower()  # bytes: A to Z only
    flat = np.frombuffer(joined, np.uint8)
    kind = _KIND[flat]
    at = np.flatnonzero(kind == 0)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none, joined
    head = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    size = np.diff(np.r_[head, len(at)])
    begin = at[head]
    inside = np.arange(len(at)) - np.repeat(head, size)
    keys = mix(np.arange(int(size.max()) + 1, dtype=np.uint64) * _A + np.uint64(seed * 2 + 1))
    hashed = np.add.reduceat((flat[at].astype(np.uint64) + np.uint64(1)) * keys[inside], head)
    doc = np.searchsorted(np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))), begin, "right")
    own = {x: int.from_bytes(hashlib.md5(x.encode("utf-8", "surrogatepass")).digest()[:8], "little") for x in set(langs)}
    salt = np.array([own[x] for x in langs], np.uint64)
    piece = np.cumsum(kind == 2, dtype=np.int64)[begin]
    return mix(mix(hashed + size.astype(np.uint64)) ^ salt[doc]), piece, doc, begin, begin + size, joined


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str]]]:
    for b in batches:
        for a, z in slices(sizes_of(b.column(1)), BATCH_BYTES):
            yield b.column(0).slice(a, z - a).to_pylist(), b.column(1).slice(a, z - a).to_pylist()


def _counted_words(docs: DataFrame, seed: int) -> DataFrame:
    """``lang``, ``h``, ``f`` and ``word`` of every word; a hash that stands for two words has them in ``word`` and ``other``."""

    def out(held: dict[int, list]) -> pa.RecordBatch:
        rows = list(held.values())
        kinds = [("lang", pa.string(), [r[0] for r in rows]), ("h", pa.int64(), np.array(list(held), np.uint64).view(np.int64)), ("word", pa.string(), [r[1] for r in rows]), ("f", pa.int64(), [r[2] for r in rows])]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for _, k, v in kinds], [n for n, _, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for langs, texts in _batches(batches):
            h, _, doc, begin, end, joined = scan(langs, texts, seed)
            key, first, times = np.unique(h, return_index=True, return_counts=True)
            for k, d, b, e, n in zip(key.tolist(), doc[first].tolist(), begin[first].tolist(), end[first].tolist(), times.tolist(), strict=True):
                if k in held:
                    held[k][2] += n
                else:
                    held[k] = [langs[d], joined[b:e].decode("utf-8", "replace"), n]
            if len(held) > HELD:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    found = docs.mapInArrow(run, "lang string, h long, word string, f long")
    return found.groupBy("h").agg(F.first("lang").alias("lang"), F.sum("f").alias("f"), F.min("word").alias("word"), F.max("word").alias("other"))


def _two_to_the(n: int, most: int) -> int:
    return min(most, 1 << max(12, (max(1, n) - 1).bit_length()))


def _levels(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest count class of the words in each slot, 0 where there is none."""
    slots = _two_to_the(4 * words.count(), MOST_SLOTS)
    found = words.groupBy(F.col("h").bitwiseAND(slots - 1).cast("int").alias("slot")).agg(F.min("f").alias("low"), F.max("f").alias("high")).toArrow()
    low, high = np.zeros(slots, np.uint16), np.zeros(slots, np.uint16)
    at = np.array(found["slot"], np.int64)
    low[at] = np.floor(np.log2(np.array(found["low"], np.float64)) * STEPS) + 1
    high[at] = np.ceil(np.log2(np.array(found["high"], np.float64)) * STEPS) + 1
    return low, high


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _A + mix(b + _B))


def _bits(pairs: DataFrame) -> np.ndarray:
    """Bit table of pairs (``x``, ``y``) as bytes."""
    bits = _two_to_the(16 * pairs.count(), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.array(c, np.int64).view(np.uint64) for c in b.columns)
            slot = (_pair(x, y) & np.uint64(bits - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 5), pa.array(np.int64(1) << (slot & 31))], ["at", "bit"])

    found = pairs.mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(bits >> 5, np.uint32)
    table[np.array(found["at"], np.int64)] = np.array(found["bit"], np.int64)
    return table


def _has(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(len(table) * 32 - 1)
    return (table[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def _grown(docs: DataFrame, seed: int, choose: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Counts ``a`` of the pairs (``h3`` is 0) and triples of words that ``choose`` takes, from hashes and pieces, by where they begin."""

    def rows(parts: list[np.ndarray]) -> pa.RecordBatch:
        order = np.lexsort(parts[::-1])
        parts = [p[order] for p in parts]
        new = np.flatnonzero(np.r_[True, np.any([p[1:] != p[:-1] for p in parts], 0)]) if len(order) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([*[pa.array(p[new].view(np.int64)) for p in parts], pa.array(np.diff(np.r_[new, len(order)]))], ["h1", "h2", "h3", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _batches(batches):
            h, piece, *_ = scan(langs, texts, seed)
            two, three = choose(h, piece)
            third = np.r_[np.zeros(len(two), np.uint64), h[three + 2]]
            yield rows([np.r_[h[two], h[three]], np.r_[h[two + 1], h[three + 1]], third])

    return docs.mapInArrow(run, "h1 long, h2 long, h3 long, a long").groupBy("h1", "h2", "h3").agg(F.sum("a").alias("a"))


def _score(a: str, left: str, right: str) -> Column:
    d = lambda x: f"cast({x} AS decimal(19,0))"
    return F.expr(f"(({d(a)} * {d(a)}) * {MILLION}) div ({d(left)} * {d(right)})")


def _round(docs: DataFrame, seed: int, words: DataFrame, levels: tuple[np.ndarray, np.ndarray], floor: int, least: int, share: int) -> DataFrame:
    """All phrases with a score of ``floor`` or more that no longer one displaces: ``lang``, ``phrase``, ``a``, ``l``, ``r``, ``score``."""
    low, high = levels
    mask = np.uint64(len(low) - 1)
    room = math.log2(floor / MILLION) * STEPS - 1e-6 if floor else -math.inf

    def promising(h: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (h & mask).astype(np.int64)
        lo, hi = low[slot].astype(np.int64), high[slot].astype(np.int64)
        ok = lo > 0
        two = np.flatnonzero((piece[1:] == piece[:-1]) & ok[1:] & ok[:-1] & (np.minimum(hi[1:], hi[:-1]) - np.maximum(lo[1:], lo[:-1]) >= room))
        most = np.minimum(np.minimum(hi[2:], hi[1:-1]), hi[:-2])
        three = np.flatnonzero((piece[2:] == piece[:-2]) & ok[2:] & ok[1:-1] & ok[:-2] & (most - np.maximum(lo[2:], lo[:-2]) >= room))
        return two, three

    found = stash(_grown(docs, seed, promising).where(F.col("a") >= least), "grown")
    word = lambda i, *more: words.select(F.col("h").alias(f"h{i}"), F.col("f").alias(f"f{i}"), F.col("word").alias(f"w{i}"), *more)
    ends = found.join(word(1, "lang"), "h1").join(word(2), "h2")
    pairs = ends.where("h3 = 0").withColumn("score", _score("a", "f1", "f2")).where(F.col("score") >= floor)
    pairs = stash(pairs.select("lang", "h1", "h2", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score"), "pairs")
    triples = ends.where("h3 <> 0").join(word(3), "h3").where(F.lit(MILLION) * F.col("a") >= F.lit(floor) * F.greatest("f1", "f3"))
    triples = stash(triples.select("lang", "h1", "h2", "h3", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "f1", "f3"), "triples")

    edge = lambda df, x, y: df.select(F.col(x).alias("x"), F.col(y).alias("y"))
    inner = _bits(edge(triples, "h1", "h2").union(edge(triples, "h2", "h3")).distinct())
    outer = _bits(edge(pairs, "h1", "h2"))

    def needed(h: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        met = np.flatnonzero(piece[1:] == piece[:-1])
        key = _pair(h[met], h[met + 1])
        around = np.zeros(max(0, len(h) - 1), bool)
        around[met[_has(outer, key)]] = True
        three = np.flatnonzero((piece[2:] == piece[:-2]) & (around[1:] | around[:-1])) if len(h) > 2 else np.zeros(0, np.int64)
        return met[_has(inner, key)], three

    more = stash(_grown(docs, seed, needed).where(F.col("a") >= least), "needed")
    inside = more.where("h3 = 0")
    prefix = inside.select("h1", "h2", F.col("a").alias("p"))
    rest = inside.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("q"))
    cuts = triples.join(prefix, ["h1", "h2"]).join(rest, ["h2", "h3"]).withColumns({"s1": _score("a", "f1", "q"), "s2": _score("a", "p", "f3")})
    early = F.col("s1") <= F.col("s2")
    either = lambda x, y: F.when(early, F.col(x)).otherwise(F.col(y))
    long = cuts.select("lang", "phrase", "a", either("f1", "p").alias("l"), either("q", "f3").alias("r"), F.least("s1", "s2").alias("score"))

    around = more.where("h3 <> 0")
    side = lambda x, y: around.select(F.col(x).alias("h1"), F.col(y).alias("h2"), F.col("a").alias("b"))
    largest = side("h1", "h2").union(side("h2", "h3")).groupBy("h1", "h2").agg(F.max("b").alias("b"))
    free = pairs.join(largest, ["h1", "h2"], "left").where(F.col("b").isNull() | (100 * F.col("b") < share * F.col("a")))
    return long.where(F.col("score") >= floor).unionByName(free.select("lang", "phrase", "a", "l", "r", "score"))


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # each salt keeps its first ones, before and after the shuffle, so no language meets in one task whole
    place = F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))
    first = found.withColumn("_salt", spread("phrase", SALTS)).withColumn("_place", place).where(F.col("_place") <= top).drop("_salt", "_place")
    bucket = F.floor((MILLION - F.col("score")) / F.lit(4096)).cast("long")
    return positions(first, ["lang"], order, bucket, "rank").where(F.col("rank") < top).withColumn("rank", F.col("rank") + 1)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    docs = docs.select(F.coalesce(docs[lang].cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(docs[text], F.lit("")).alias("text"))
    for seed in range(8):
        counted = stash(_counted_words(docs, seed), "words")
        if counted.where("word <> other").isEmpty():
            break
    else:
        raise ArithmeticError("words with equal hashes under every seed")
    totals = stash(counted.groupBy("lang").agg(F.sum("f").alias("n"), F.count_if(F.col("f") >= least).alias("_w")), "totals")
    words = stash(counted.where(F.col("f") >= least).select("lang", "h", "f", "word"), "frequent")
    levels = _levels(words)
    # a phrase needs words that are frequent enough
    open_, floor, done = totals.where("_w > 0").select("lang"), FIRST, []
    while not open_.isEmpty():
        found = stash(_round(docs.join(open_, "lang", "left_semi"), seed, words, levels, floor, least, share), "found")
        size = found.groupBy("lang").agg(F.count(F.lit(1)).alias("_k"))
        state = stash(open_.join(size, "lang", "left").select("lang", F.coalesce("_k", F.lit(0)).alias("_k")), "state")
        settled = state if floor == 0 else state.where(F.col("_k") >= top)
        done.append(found.join(settled.select("lang"), "lang", "left_semi"))
        if floor == 0:
            break
        open_ = state.where(F.col("_k") < top).select("lang")
        fewest = state.where(F.col("_k") < top).agg(F.min("_k")).first()[0]
        floor = min(floor // 4, floor * (fewest or 0) // (2 * top))
        floor = floor if floor >= LAST else 0
    if not done:
        return totals.where("false").selectExpr("lang", "n AS rank", "lang AS phrase", "n AS a", "n AS l", "n AS r", "n", "n AS score")
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return _ranked(every, top).join(totals.select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, folder: str) -> DataFrame:
    """The first 2,000 collocations of each language of ``documents``."""
    return collocations(spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang"))


SQL = f"""
WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3]) AS k))) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, g, f AS a, string_split(g, ' ') AS q FROM g WHERE k > 1 AND f >= {LEAST}),
s AS (SELECT c.lang, c.k, c.g, c.a, j, x.f AS l, y.f AS r, ({MILLION}::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN g x ON x.lang = c.lang AND x.k = j AND x.g = array_to_string(q[1:j], ' ')
  JOIN g y ON y.lang = c.lang AND y.k = c.k - j AND y.g = array_to_string(q[j + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.g ORDER BY score, j) = 1),
b AS (SELECT lang, g, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(q[1:2], ' '), array_to_string(q[2:3], ' ')]) AS g FROM c WHERE k = 3) GROUP BY ALL),
o AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.g) AS rank
  FROM s LEFT JOIN b ON b.lang = s.lang AND b.g = s.g AND s.k = 2 WHERE b.a IS NULL OR 100 * b.a < {SHARE} * s.a)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= {TOP}"""
