"""N-gram Jaccard join: adaptive multi-match prefixes, exact links, connected classes.

Two sets of ``width``-word shingles link when their Jaccard similarity is ``percent`` or more, here 0.9. A linked set misses at most
``n - ceil(0.9 n)`` tokens of a set of n, so of the first ``n - ceil(0.9 n) + l`` tokens in one global order, rarest first, the two share at least l. Each document takes its
own l by the estimated cost of its candidates; a pair must share the smaller of the two.

1. Frequencies: each task adds up shingles in ``SLOTS`` counters; what a slot holds beyond the usual orders tokens by class and then by hash.
2. Equal sets form one class with one representative; only classes go on.
3. Prefix tokens that two classes hold are buckets. First, each class is compared with one pivot, that of its largest bucket, where the pivot is the member
   with the most companions; so a group of copies is one component after as many rows as it has members. Then the members of a bucket meet its own
   pivot unless they are in its component, not each other. Members that are then in one component need no comparison. Of the buckets
   that still span components, those of up to ``HOT`` classes are compared pairwise.
4. The sets in larger open buckets are counted exactly: a token that no other of these sets holds cannot be shared, so a set
   with too many of them is done, and the others choose their prefixes anew among the shared tokens. That ends groups of copies
   that are similar but not linked, without listing their pairs. What is left is compared with ``SEVERAL`` pivots of each bucket, then
   with ``MORE`` times as many each round, until no bucket spans components.
5. A pair goes on only if the counts of its tokens by bin leave room for a link. Links are verified on whole sets, the companions of a pivot in parts of about ``HOT``, and components are found by passing on the smallest label.

Sets are compared by 64-bit hashes of shingles; classes have 128-bit keys and, in all that follows, numbers. Nothing that grows with the data is collected; tables
are broadcast only while their counted rows stay below ``BROADCAST_ROWS``.

Odd input: a null text, an empty one and one without words have an empty set, link with nothing and keep their own id; shorter texts
than a shingle count as one shingle; repeated rows link with each other; a null id is never the smallest id of a class, and a class of
null ids has a null class id; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainwright.llm.batches import append, sizes_of, slices
from chainwright.llm.shingles import mix, shingle_sets
from chainwright.session import stash

WIDTH = 3
PERCENT = 90
#: Counters, and how many of them go in one row.
SLOTS, LANES = 1 << 21, 16
LONGEST = 8
#: Buckets of up to so many classes are compared pairwise in the second step, larger ones go by pivots.
HOT = 64
#: Pivots of a bucket in the first round that counts exactly.
SEVERAL = 8
#: Prefixes of up to so many tokens travel with their postings, so that a pair is met once and its shared tokens are counted where it is met.
CARRIED = 64
#: Factor by which each further round takes more pivots, so rounds grow with the logarithm of the largest bucket.
MORE = 16
#: Mean companions of a prefix token from which a longer prefix is taken.
COSTLY = 16.0
BROADCAST_ROWS = 1_000_000
#: Tables of shared tokens, which grow fastest, are broadcast up to so many rows.
BROADCAST_TOKENS = 100_000
#: Bins of the token counts that bound an overlap, and the count from which a bin says nothing.
BINS, FULL = 256, 32_000
#: Rows with such counts (about 500 bytes) are broadcast up to so many.
BROADCAST_COUNTS = 20_000
BATCH_CHARS = 500_000


def frequencies(docs: DataFrame, text: str, width: int = WIDTH) -> np.ndarray:
    """Sums of shingles by slot over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            for a, z in slices(sizes_of(b.column(0)), BATCH_CHARS):
                hashes, _ = shingle_sets([x or "" for x in b.column(0).slice(a, z - a).to_pylist()], width)
                total += np.bincount((hashes & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        rows = total.reshape(-1, LANES)
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(rows[used, i]) for i in range(LANES)]], ["at", *lanes])

    lanes = [f"n{i}" for i in range(LANES)]
    found = docs.select(text).mapInArrow(count, "at int, " + ", ".join(f"{x} long" for x in lanes)).groupBy("at").agg(*[F.sum(x).alias(x) for x in lanes]).toArrow()
    out = np.zeros((SLOTS // LANES, LANES), np.int64)
    at = np.array(found["at"], np.int64)
    for i, x in enumerate(lanes):
        out[at, i] = np.array(found[x])
    return out.reshape(-1)


def _classes_of(counts: np.ndarray) -> np.ndarray:
    """Class of each slot: half octaves of its count beyond the usual one."""
    return np.floor(2 * np.log2(np.maximum(counts - np.median(counts), 0) + 1)).astype(np.uint8)


def prefix_of(tokens: np.ndarray, level: np.ndarray, noise: float, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The prefix of one set and the matches it asks for; ``noise`` is what a slot may hold beyond the usual by chance."""
    n = len(tokens)
    need = -(-percent * n // 100)
    own = level[(tokens & np.uint64(SLOTS - 1)).astype(np.int64)]
    order = np.lexsort((tokens, own))
    cost = np.maximum(np.exp2(own[order[: n - need + 1]] / 2) - 1 - noise, 0).mean()
    matches = int(min(need, 1 + max(0, np.floor(np.log2(cost / COSTLY + 1))), LONGEST))
    return tokens[order[: n - need + matches]], matches


def sketch(docs: DataFrame, text: str, counts: np.ndarray, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Add ``_n`` (set size), ``_c`` (128-bit key of the set, null if empty), ``_prefix``, ``_matches`` and ``_hist``, the tokens by ``BINS``."""
    level, noise = _classes_of(counts), float(4 * np.sqrt(np.median(counts) + 1))
    fields = [T.StructField("_n", T.LongType()), T.StructField("_c", T.BinaryType()), T.StructField("_prefix", T.ArrayType(T.LongType())), T.StructField("_matches", T.IntegerType()), T.StructField("_hist", T.ArrayType(T.ShortType()))]

    def work(values: pa.Array) -> list[pa.Array]:
        hashes, at = shingle_sets([x or "" for x in values.to_pylist()], width)
        size = np.diff(at)
        keys, prefixes, matches = _keys(hashes, at), [], []
        for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            got, m = prefix_of(hashes[a:z], level, noise, percent) if z > a else (hashes[:0], 0)
            prefixes.append(got.view(np.int64))
            matches.append(m)
        flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
        ends = np.r_[0, np.cumsum([len(p) for p in prefixes])].astype(np.int32)
        bins = np.repeat(np.arange(len(size)) * BINS, size) + (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        hist = np.minimum(np.bincount(bins, minlength=len(size) * BINS), FULL).astype(np.int16)
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * BINS), pa.array(hist))
        return [pa.array(size), keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(matches, pa.int32()), each]

    return append(docs, text, fields, work, BATCH_CHARS)


def _keys(hashes: np.ndarray, at: np.ndarray) -> pa.Array:
    """Order-free 128-bit keys of sets, null for an empty one."""
    some = np.flatnonzero(np.diff(at))
    out = [None] * (len(at) - 1)
    if len(some):
        begin = at[some]
        parts = np.stack([np.add.reduceat(mix(hashes + np.uint64(k)), begin) for k in (0x51ED27, 0xA3B195)], 1)
        for i, p in zip(some.tolist(), parts, strict=True):
            out[i] = p.tobytes()
    return pa.array(out, pa.binary())


def _near(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame marked for broadcast while it is small; rows are counted first."""
    return F.broadcast(df) if df.count() <= rows else df


def _links(a: Column, b: Column, shared: Column, percent: int) -> Column:
    return 100 * shared >= percent * (a + b - shared)


def _may(a: Column, b: Column, percent: int) -> Column:
    """Whether sizes allow a link."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def components(edges: DataFrame) -> DataFrame:
    """``c`` and ``label``, the smallest key of its component, for all keys that have an edge (``a``, ``b``)."""
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stash(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "c"), "labels")
    changed = labels
    while not changed.isEmpty():
        # only labels that fell since the last step are passed on
        told = both.join(_near(changed.select(F.col("c").alias("b"), "label")), "b").groupBy(F.col("a").alias("c")).agg(F.min("label").alias("_new"))
        known = _near(labels)
        # a label is a key of the same component and may know a smaller one
        jump = known.select(F.col("c").alias("_new"), F.col("label").alias("_far"))
        fell = told.join(jump, "_new", "left").select("c", F.least("_new", F.coalesce("_far", "_new")).alias("_low"))
        fell = stash(fell.join(known, "c").where("_low < label").select("c", F.col("_low").alias("label")), "fell")
        changed = fell
        labels = stash(labels.join(_near(fell.withColumnRenamed("label", "_low")), "c", "left").select("c", F.coalesce("_low", "label").alias("label")), "labels")
    return labels


def _buckets(postings: DataFrame) -> DataFrame:
    """Postings of the tokens that at least two classes hold, with the number ``k`` of holders.

    Most tokens have one holder, so postings carry only what cannot be had after the join. A full posting has the token ``t``, the class ``c``, the size ``n`` of its set, the matches ``m`` it asks for, the place ``i`` of the token among
    the ``r`` tokens of the class that are in order, and the length ``p`` of its prefix.
    """
    held = stash(postings.groupBy("t").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "tokens")
    return stash(postings.join(_near(held, BROADCAST_TOKENS), "t"), "buckets")


def _tagged(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Add ``g``, the component of each posting; without ``labels`` each class is one."""
    if labels is None:
        return postings.withColumn("g", F.col("c"))
    return postings.join(_near(labels), "c", "left").withColumn("g", F.coalesce("label", "c")).drop("label")


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Buckets that span components, with the component ``g`` of each posting."""
    tagged = _tagged(buckets, labels)
    span = tagged.groupBy("t").agg((F.min("g") != F.max("g")).alias("_o"), F.count(F.lit(1)).alias("_k")).where("_o")
    return tagged.drop("k").join(_near(stash(span.select("t", F.col("_k").alias("k")), "open")), "t")


def _pivots(buckets: DataFrame, many: int) -> DataFrame:
    """The postings (``t``, ``c``, ``n``, ``r``; ``p``, ``f`` if there is an ``f``) of the ``many`` members of each bucket that have the most companions in all their buckets."""
    cost = _near(stash(buckets.groupBy("c").agg(F.sum("k").alias("w")), "cost"))
    ranked = buckets.select("t", "c", "n", "r", *[x for x in ("p", "f") if "f" in buckets.columns]).join(cost, "c")
    place = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("w"), "c"))
    return stash(ranked.withColumn("_p", place).where(F.col("_p") <= many).drop("_p", "w"), "pivots")


def _without(buckets: DataFrame, pivots: DataFrame, many: int) -> DataFrame:
    """The postings that have not met each other: those of the pivots leave, and so do buckets of which at most one member is left."""
    return buckets.where(F.col("k") > many + 1).join(_near(pivots.select("t", "c")), ["t", "c"], "left_anti")


def _fits(buckets: DataFrame, mine: DataFrame, percent: int) -> Column:
    """Whether two postings of one token are in different components and their sizes allow a link."""
    sizes = _may(F.col("a_n"), F.col("n"), percent) & ((100 + percent) * F.least("a_r", "r") >= percent * (F.col("a_n") + F.col("n")))
    return (buckets["t"] == mine["t"]) & (F.col("a_g") != F.col("g")) & sizes


def _renamed(buckets: DataFrame) -> DataFrame:
    return buckets.select("t", *[F.col(x).alias(f"a_{x}") for x in ("c", "n", "m", "i", "r", "p", "g")])


def _with_pivots(buckets: DataFrame, pivots: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (``a`` pivot, ``b``) of different components whose sizes allow a link: each bucket meets its own pivots only."""
    more = [x for x in ("p", "f") if x in pivots.columns and "f" in pivots.columns]
    mine = _near(_tagged(pivots, labels).select("t", *[F.col(x).alias(f"a_{x}") for x in ("c", "n", "r", *more, "g")]))
    met = _tagged(buckets.select("t", "c", "n", "r", *more), labels)
    fits = _fits(met, mine, percent)
    if more:
        # up to the end of the prefix that ends first all shared tokens are in both prefixes
        both = F.array_intersect("a_f", "f")
        most = F.size(both) + F.greatest(F.least(F.expr("a_r - a_p"), F.col("r") - F.size(both)), F.least(F.col("a_r") - F.size(both), F.expr("r - p")))
        once = (F.get(both, F.lit(0)) == met["t"]) & ((100 + percent) * most >= percent * (F.col("a_n") + F.col("n")))
        fits &= F.col("a_f").isNull() | F.col("f").isNull() | once
    return met.join(mine, fits).select(F.col("a_c").alias("a"), F.col("c").alias("b")).distinct()


def _candidates(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) of different components that may link.

    The shared tokens of two prefixes are counted. Up to the end of the prefix that ends first they are all that the two share, and
    behind it they share at most what the shorter rest holds; together that must reach what their sizes ask for.
    """
    mine = _renamed(buckets)
    met = buckets.join(mine, _fits(buckets, mine, percent) & (F.col("a_c") < F.col("c")))
    one = lambda x: F.first(x).alias(x)
    seen = met.groupBy(F.col("a_c").alias("a"), F.col("c").alias("b")).agg(
        F.count(F.lit(1)).alias("s"), F.max("a_i").alias("a_i"), F.max("i").alias("i"), *[one(x) for x in ("a_n", "n", "a_m", "m", "a_r", "r", "a_p", "p")]
    )
    rest = F.greatest(F.least(F.expr("a_r - a_p"), F.expr("r - i - 1")), F.least(F.expr("a_r - a_i - 1"), F.expr("r - p")))
    enough = (100 + percent) * (F.col("s") + rest) >= percent * (F.col("a_n") + F.col("n"))
    return seen.where(enough & (F.col("s") >= F.least("a_m", "m"))).select("a", "b")


def _dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs with the ``part`` of the companions of ``a`` that ``b`` is in, and ``c``, ``part`` of every part, so that no pivot is one group."""
    parts = stash(pairs.groupBy("a").agg(F.ceil(F.count("b") / HOT).cast("long").alias("_parts")), "parts")
    dealt = pairs.join(_near(parts), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_parts")).alias("part"))
    return dealt, parts.select(F.col("a").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("part"))


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose token counts by bin leave room for a link: two sets share at most the smaller count of each bin."""
    pairs, heads = _dealt(stash(pairs, "pairs"))
    right = classes.select(F.col("c").alias("b"), F.col("n").alias("n_b"), F.col("hist").alias("h_b")).join(_near(stash(pairs, "dealt")), "b")
    heads = stash(classes.join(_near(heads), "c").select(F.col("c").alias("a"), "part", F.col("n").alias("n_a"), F.col("hist").alias("h_a")), "heads")
    smaller = F.zip_with("h_a", "h_b", lambda x, y: F.when((x >= FULL) & (y >= FULL), F.lit(1 << 30)).otherwise(F.least(x, y).cast("int")))
    most = F.aggregate(smaller, F.lit(0).cast("long"), lambda t, x: t + x)
    room = (100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))
    return stash(right.join(_near(heads, BROADCAST_COUNTS), ["a", "part"]).where(room).select("a", "b"), "bounded")


def _with_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` (``rep``, ``key``, ``c``, more) with ``n`` and ``s``, the whole set of the class ``c``, made anew from a text.

    The wanted rows meet the documents where they are read, so texts are not shuffled while they can be broadcast.
    """
    wanted = stash(wanted, "wanted")
    kept = [x for x in wanted.columns if x not in ("rep", "key")]
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    rows = rows.join(_near(wanted), F.col("_id").eqNullSafe(F.col("rep"))).select(*kept, "key", "_text")

    def work(values: pa.Array) -> list[pa.Array]:
        hashes, at = shingle_sets([x or "" for x in values.to_pylist()], width)
        return [_keys(hashes, at), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))]

    made = append(rows, "_text", [T.StructField("_of", T.BinaryType()), T.StructField("s", T.ArrayType(T.LongType()))], work, BATCH_CHARS)
    return made.where(F.col("_of") == F.col("key")).select(*kept, F.size("s").cast("long").alias("n"), "s")


def _sets(docs: DataFrame, key: str, text: str, reps: DataFrame, width: int) -> DataFrame:
    """``c``, ``n`` and ``s`` of the classes in ``reps``."""
    made = stash(_with_sets(docs, key, text, reps.select("rep", "key", "c"), width), "sets")
    # only repeated rows of one id give a class twice
    return made if made.count() == made.select("c").distinct().count() else stash(made.dropDuplicates(["c"]), "sets")


def _linking(members: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) whose whole sets link, from (``a``, ``part``, ``c``, ``n``, ``s``) and (``c``, ``part``, ``n``, ``s``)."""
    left = pivots.select(F.col("c").alias("a"), "part", F.col("n").alias("n_a"), F.col("s").alias("s_a"))
    both = members.join(left, ["a", "part"])
    return both.where(_links(F.col("n_a"), F.col("n"), F.size(F.array_intersect("s_a", "s")), percent)).select("a", F.col("c").alias("b")).distinct()


def _peeled(tokens: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Postings of the shared tokens of open sets (``c``, ``n``, ``t``), with ``r`` the number of shared ones and the prefix ``f``; and those tokens.

    Sets that lack the shared tokens for any link leave, which may leave more tokens alone, until hardly any does; a set that stays too long is no
    fault, it is compared. A token that nothing else holds is not looked at again.
    """
    before = tokens.select("c").distinct().count()
    while True:
        held = stash(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "held")
        shared = stash(tokens.join(_near(held), "t"), "shared")
        left = shared.groupBy("c", "n").agg(F.count(F.lit(1)).alias("left"))
        now = stash(left.where(100 * F.col("left") >= percent * F.col("n")), "alive")
        after = now.count()
        if 10 * after >= 9 * before:
            break
        before = after
        tokens = stash(shared.select("c", "n", "t").join(_near(now.select("c")), "c", "left_semi"), "tokens")
    # prefixes among the shared tokens, rarest first; the missing ones are already used up
    ordered = F.array_sort(F.collect_list(F.struct("k", "t")))
    again = shared.join(_near(now.select("c", "left")), "c").groupBy("c", "n", "left").agg(ordered.alias("_o"))
    missing = F.col("left") - F.ceil(F.col("n") * percent / F.lit(100)).cast("long")
    again = again.withColumn("_p", F.slice("_o", 1, (missing + 1).cast("int")))
    return again.select("c", "n", F.lit(1).alias("m"), F.col("left").alias("r"), F.size("_p").alias("p"), F.when(F.size("_p") <= CARRIED, F.col("_p.t")).alias("f"), F.posexplode("_p.t").alias("i", "t")), shared.select("c", "n", "t")


def linked(docs: DataFrame, key: str, text: str, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``_id``, ``_mark`` (digest of the text), ``_n``, ``_g`` (key of the component, null for an empty set) and ``component`` of every row."""
    counts = frequencies(docs, text, width)
    rows = docs.select(F.col(key).alias("_id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_mark"), F.col(text).alias("_text"))
    made = stash(sketch(rows, "_text", counts, width, percent).drop("_text").withColumn("_row", F.monotonically_increasing_id()), "sketches")
    # only keys are grouped, so prefixes and counts stay where they were made
    copies = made.where("_c IS NOT NULL").groupBy(F.col("_c").alias("_k")).agg(F.count(F.lit(1)).alias("_many"), F.min("_id").alias("_least"), F.min("_row").alias("_one"))
    copies = _near(stash(copies.where("_many > 1").drop("_many"), "copies"))
    own = made.where("_c IS NOT NULL").join(copies, F.col("_c") == F.col("_k"), "left").where("_one IS NULL OR _one = _row")
    rep = F.when(F.col("_one").isNull(), F.col("_id")).otherwise(F.col("_least")).alias("rep")
    classes = stash(own.select(F.col("_row").alias("c"), F.col("_c").alias("key"), rep, F.col("_n").alias("n"), F.col("_matches").alias("m"), "_prefix", F.col("_hist").alias("hist")), "classes")
    reps = classes.select("c", "key", "rep")
    buckets = _buckets(classes.select(F.posexplode("_prefix").alias("i", "t"), "c")).join(_near(classes.select("c", "n", "m")), "c")
    buckets = stash(buckets.withColumns({"r": F.col("n"), "p": F.expr(f"n - ({percent} * n + 99) div 100 + m")}), "buckets")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs, heads = _dealt(_bounded(pairs, classes, percent))
        asked = reps.withColumnRenamed("c", "b").join(_near(pairs), "b").select("rep", "key", F.col("b").alias("c"), "a", "part")
        heads = reps.join(_near(heads), "c").select("rep", "key", "c", "part")
        return stash(_linking(_with_sets(docs, key, text, asked, width), _with_sets(docs, key, text, heads, width), percent), "links")

    pivots = _pivots(buckets, 1)
    # one pivot for each class, that of its largest bucket, so a group of copies makes one row per member and not one per posting
    largest = stash(buckets.groupBy("c").agg(F.max(F.struct("k", "t")).alias("_m")).select("c", F.col("_m.t").alias("t")), "largest")
    met = largest.join(_near(pivots.withColumnsRenamed({"c": "a_c", "n": "a_n", "r": "a_r"})), "t").where("c <> a_c").join(_near(classes.select("c", "n")), "c")
    links = verified(met.where(_may(F.col("a_n"), F.col("n"), percent)).select(F.col("a_c").alias("a"), F.col("c").alias("b")))
    labels = components(links)
    links = links.union(verified(_with_pivots(buckets, pivots, labels, percent)))
    labels = components(links)
    waiting = stash(_open(_without(buckets, pivots, 1), labels), "waiting")
    links = links.union(verified(_candidates(waiting.where(F.col("k") <= HOT), percent)))
    labels = components(links)
    waiting = stash(_open(waiting.where(F.col("k") > HOT).drop("g"), labels), "waiting")
    sets, tokens, many, listed = None, None, SEVERAL, 0
    while not waiting.isEmpty():
        still = stash(waiting.select("c").distinct(), "still")
        left, still = still.count(), _near(still)
        sets = _sets(docs, key, text, reps.join(still, "c", "left_semi"), width) if sets is None else stash(sets.join(still, "c", "left_semi"), "sets")
        # tokens are listed once, and looked at again only when half of the sets are done; else the postings stay as they are
        if tokens is None or 2 * left <= listed:
            tokens = stash(sets.select("c", "n", F.explode("s").alias("t")) if tokens is None else tokens.join(still, "c", "left_semi"), "tokens")
            postings, tokens = _peeled(tokens, percent)
            waiting, listed = stash(_open(_buckets(postings), labels), "waiting"), left
        pivots = _pivots(waiting, many)
        pairs, heads = _dealt(_bounded(_with_pivots(waiting, pivots, labels, percent), classes, percent))
        asked = sets.join(_near(pairs.select("a", F.col("b").alias("c"), "part")), "c")
        heads = sets.join(_near(heads), "c")
        found = stash(_linking(asked, heads, percent), "links")
        if not found.isEmpty():
            links = links.union(found)
            labels = components(links)
        waiting = stash(_open(_without(waiting, pivots, many).drop("g"), labels), "waiting")
        many *= MORE
    tagged = stash(reps.join(_near(labels), "c").select("c", "label", "rep"), "tagged")
    least = stash(tagged.groupBy("label").agg(F.min("rep").alias("component")), "least")
    better = _near(stash(tagged.join(_near(least), "label").select("c", "label", "component"), "better"))
    members = reps.join(better, "c", "left").select("key", F.coalesce("label", "c").alias("g"), F.when(F.col("label").isNull(), F.col("rep")).otherwise(F.col("component")).alias("component"))
    joined = made.select("_id", "_mark", "_n", "_c").join(members, F.col("_c") == F.col("key"), "left")
    return joined.select("_id", "_mark", "_n", F.col("g").alias("_g"), F.when(F.col("_c").isNull(), F.col("_id")).otherwise(F.col("component")).alias("component"))


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: its id, ``n_shingles`` and ``component_id``, the smallest id that is reachable by links."""
    return linked(docs, key, text, width, percent).select(F.col("_id").alias(key), F.col("_n").alias("n_shingles"), F.col("component").alias("component_id"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component, the one of the smallest id (then of the smallest digest of its text); rows with empty sets all stay.

    Only the keys of the other rows meet the documents, so texts are shuffled only if those are too many to broadcast.
    """
    rows = stash(linked(docs, key, text, width, percent).where("_g IS NOT NULL").select("_id", "_mark", "_g"), "linked")
    name = F.struct(F.col("_id").isNull().alias("no"), "_id", "_mark")
    kept = rows.groupBy("_g").agg(F.min(name).alias("_b"))
    counted = rows.groupBy("_g", "_id", "_mark").agg(F.count(F.lit(1)).alias("_k"))
    both = stash(counted.join(kept, "_g").select("_id", "_mark", "_k", name.eqNullSafe(F.col("_b")).alias("_keep")).where("NOT _keep OR _k > 1"), "fates")
    fate = _near(both.select(F.col("_id").alias("_fi"), F.col("_mark").alias("_fm"), "_keep"))
    here = lambda d: d[key].eqNullSafe(fate["_fi"]) & (F.md5(F.coalesce(d[text], F.lit(""))) == fate["_fm"])
    untouched = docs.join(fate, here(docs), "left_anti")
    again = docs.join(fate.where("_keep"), here(docs), "left_semi").withColumn("_fm", F.md5(F.coalesce(F.col(text), F.lit("")))).dropDuplicates([key, "_fm"]).drop("_fm")
    return untouched.unionByName(again)


def op10_jaccard_join(spark, folder: str) -> DataFrame:
    """Set size and class of every text of ``documents``."""
    return link(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))


SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), lambda x: true) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, CASE WHEN len(w) < {WIDTH} THEN w ELSE w[i:i + {WIDTH - 1}] END AS g
  FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - {WIDTH - 1}) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.r <> y.r GROUP BY ALL)
  JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * k >= {PERCENT} * (p.n + q.n - k)),
c(r, o) AS (SELECT r, r FROM d UNION SELECT c.r, e.b FROM c JOIN e ON e.a = c.o),
m AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.o GROUP BY c.r)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d JOIN m USING (r) LEFT JOIN n USING (r)"""
