"""Benchmark decontamination: a set join on the rarest shingle of every window, verified in place.

A window is ``WINDOW`` consecutive words of an item, or the whole item if it is shorter. A document holds a window only
if it holds all shingles of the window, so one necessary shingle, the rarest in the corpus, is enough to find all
candidates. A candidate fixes where the window would lie: it must begin at a word and end within the document, and the
words there must equal the window's. Shingles are joined by 64-bit hash; the words decide.

Distribution: shingles of a document are exploded, with only the words around them, and joined to the windows. While the number of distinct shingles of
the benchmark stays below ``broadcast_keys`` (counted first) the windows are broadcast and no shingle is shuffled;
beyond it the join is shuffled by shingle and adaptive execution splits hot shingles. Counts of shingles and hits of
a document are combined before they are shuffled.

Odd input: a null text or one without words has no hits and no windows; an item without words has no windows; equal
items are all reported; repeated document rows get equal results; a null item id is not listed or counted as an item, but
its windows hit; other columns are not read; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainwright.llm.common import hex_digest, lower_ascii

WINDOW, SHINGLE = 10, 3
#: Benchmarks of up to so many distinct shingles (about 100 bytes each) are broadcast.
BROADCAST_KEYS = 1_000_000
#: Words of a text that travel, with a window's margin on both sides, beside each shingle that begins in them.
BLOCK = 64
#: All but 0x00-2F, 3A-60 and 7B-7F. Listed one by one, ASCII letters are looked up in a table instead of compared with ranges.
WORD = r"[0123456789abcdefghijklmnopqrstuvwxyz\x80-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """Lower-cased words; a null text has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingle(tokens: Column, at: Column, width: int) -> Column:
    """Hash of ``width`` words from position ``at`` (from 0) on."""
    return F.xxhash64(F.lit(width), *[F.get(tokens, at + i) for i in range(width)])


def shingles(tokens: Column, width: int) -> Column:
    """Shingle hashes of all positions at which ``width`` words follow."""
    last = F.size(tokens) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda p: shingle(tokens, p, width))).otherwise(F.array().cast("array<bigint>"))


def windows(items: DataFrame) -> DataFrame:
    """Distinct windows: ``tokens`` and the sorted ids of the items that hold them."""
    base = items.select("item_id", words(F.col("text")).alias("_w")).where(F.size("_w") > 0).groupBy("_w").agg(F.collect_set("item_id").alias("_ids"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_w") - WINDOW))
    cut = base.select("_ids", "_w", F.explode(starts).alias("_p")).select("_ids", F.slice("_w", F.col("_p") + 1, WINDOW).alias("tokens"))
    return cut.groupBy("tokens").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ids")))).alias("ids"))


def _tokens(docs: DataFrame, widths: list[int], *kept: str) -> DataFrame:
    """One row for each shingle of each document: ``_h``, its position ``_at`` and the number ``_n`` of words."""
    work = docs.select(*kept, words(F.col("text")).alias("_w")).select("*", F.size("_w").alias("_n"))
    parts = [work.select(*kept, "_n", F.posexplode(shingles(F.col("_w"), w)).alias("_at", "_h")) for w in widths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _local_tokens(docs: DataFrame, widths: list[int], *kept: str) -> DataFrame:
    """One row for each shingle: ``_h``, and its position ``_at`` in ``_w``, the words around it from word ``_from`` of the document on.

    ``_w`` holds every window that the shingle can be part of, so its length does not depend on the text's.
    """
    work = docs.select(*kept, words(F.col("text")).alias("_all"))
    cut = lambda o: F.struct(
        o.alias("_o"), F.slice("_all", F.greatest(o - (WINDOW - 1), F.lit(0)) + 1, F.lit(BLOCK + 2 * (WINDOW - 1) + 1)).alias("_w")
    )
    starts = F.sequence(F.lit(0), F.greatest(F.size("_all") - 1, F.lit(0)), F.lit(BLOCK))
    blocks = work.select(*kept, F.inline(F.transform(starts, cut)))
    blocks = blocks.select(*kept, "_w", F.greatest(F.col("_o") - (WINDOW - 1), F.lit(0)).alias("_from"), F.least(F.col("_o"), F.lit(WINDOW - 1)).alias("_own"))
    out = None
    for width in widths:
        last = F.least(F.col("_own") + BLOCK, F.size("_w") - width + 1) - 1
        places = F.sequence("_own", F.greatest(last, F.col("_own")))
        held = F.when(last >= F.col("_own"), F.transform(places, lambda p: shingle(F.col("_w"), p, width))).otherwise(F.array().cast("array<bigint>"))
        part = blocks.select(*kept, "_w", "_from", "_own", F.posexplode(held).alias("_i", "_h"))
        part = part.select(*kept, "_w", "_from", (F.col("_own") + F.col("_i")).alias("_at"), "_h")
        out = part if out is None else out.unionByName(part)
    return out


def prefixes(docs: DataFrame, items: DataFrame, broadcast_keys: int) -> tuple[DataFrame, list[int], bool]:
    """Every window with its rarest shingle ``_h`` at ``_off``; the widths in use; whether they may be broadcast."""
    cut = windows(items)
    shortest = F.least(F.lit(SHINGLE), F.size("tokens"))
    listed = F.array()
    for w in range(1, SHINGLE + 1):
        listed = F.when(shortest == w, shingles(F.col("tokens"), w)).otherwise(listed.cast("array<bigint>"))
    cut = cut.withColumn("_hs", listed).withColumn("_width", shortest)
    sizes = cut.select("_width", F.explode("_hs").alias("_h")).groupBy("_width").agg(F.count_distinct("_h").alias("n")).collect()
    widths = sorted(r["_width"] for r in sizes)
    small = sum(r["n"] for r in sizes) <= broadcast_keys
    if not widths:
        return cut.select("tokens", "ids", F.lit(0).alias("_off"), F.lit(0).cast("long").alias("_h")), [], small
    keys = cut.select(F.explode("_hs").alias("_h")).distinct()
    found = _tokens(docs, widths).select("_h").join(F.broadcast(keys) if small else keys, "_h").groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    each = cut.select("tokens", "ids", F.posexplode("_hs").alias("_off", "_h"))
    ranked = each.join(found, "_h", "left").groupBy("tokens", "ids").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_h").alias("h"), F.col("_off").alias("o"))).alias("_r"))
    # A shingle that no document holds ends the search for its window.
    return ranked.where(F.col("_r.n") > 0).select("tokens", "ids", F.col("_r.o").alias("_off"), F.col("_r.h").alias("_h")), widths, small


def marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, text and a digest of the text: together they name a row up to repeated rows."""
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).withColumn("_mark", F.md5(F.coalesce("text", F.lit(""))))


def overlaps(docs: DataFrame, items: DataFrame, broadcast_keys: int) -> DataFrame:
    """``_k``, ``_m``, ``hits`` and ``items`` of the marked documents that hold a window."""
    cut, widths, small = prefixes(docs, items.select("item_id", "text"), broadcast_keys)
    cut = cut.withColumnRenamed("_h", "_hw")
    begin, length = F.col("_at") - F.col("_off"), F.size("tokens")
    if small:
        tokens = _local_tokens(docs, widths or [SHINGLE], "_key", "_mark")
        same = F.slice("_w", begin + 1, length) == F.col("tokens")
        fits = F.when((begin >= 0) & (begin + length <= F.size("_w")), same).otherwise(False)
        start = F.col("_from") + begin
        met = tokens.join(F.broadcast(cut), (F.col("_h") == F.col("_hw")) & fits).select("_key", "_mark", start.alias("s"), (start + length).alias("e"), "ids")
    else:
        # shuffled shingles carry positions only; the words of a document meet its candidates once
        held = _tokens(docs, widths or [SHINGLE], "_key", "_mark")
        found = held.join(cut, (F.col("_h") == F.col("_hw")) & (begin >= 0) & (begin + length <= F.col("_n")))
        per = found.groupBy(F.col("_key").alias("_ck"), F.col("_mark").alias("_cm")).agg(F.collect_set(F.struct(begin.alias("s"), "tokens", "ids")).alias("_c"))
        both = per.join(docs.dropDuplicates(["_key", "_mark"]), F.col("_key").eqNullSafe(F.col("_ck")) & (F.col("_mark") == F.col("_cm")))
        both = both.select("_key", "_mark", words(F.col("text")).alias("_w"), "_c")
        sure = F.filter("_c", lambda c: F.slice("_w", c["s"] + 1, F.size(c["tokens"])) == c["tokens"])
        met = both.select("_key", "_mark", F.explode(sure).alias("_c")).select("_key", "_mark", F.col("_c.s").alias("s"), (F.col("_c.s") + F.size("_c.tokens")).alias("e"), "_c.ids")
    per_doc = met.groupBy("_key", "_mark").agg(
        F.array_sort(F.collect_set(F.struct("s", "e"))).alias("hits"), F.collect_set("ids").alias("_sets")
    )
    return per_doc.select(F.col("_key").alias("_k"), F.col("_mark").alias("_m"), "hits", F.array_sort(F.array_distinct(F.flatten("_sets"))).alias("items"))


def find_overlap(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Per document row: ``n_words``, ``hits`` (array of start and end in words) and ``items`` (sorted ids)."""
    docs = marked(docs, key, text)
    per_doc = overlaps(docs, items, broadcast_keys)
    counted = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD.replace("z", "zABCDEFGHIJKLMNOPQRSTUVWXYZ")), F.lit(0))
    base = docs.select("_key", "_mark", F.size(counted).cast("long").alias("n_words"))
    none_hit, none_item = F.array().cast("array<struct<s:int,e:int>>"), F.array().cast(per_doc.schema["items"].dataType)
    both = base.join(per_doc, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_mark") == F.col("_m")), "left")
    return both.select(F.col("_key").alias(key), "n_words", F.coalesce("hits", none_hit).alias("hits"), F.coalesce("items", none_item).alias("items"))


def without_overlap(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The documents that hold no window, all columns as they are."""
    held = overlaps(marked(docs, key, text), items, broadcast_keys).select("_k", "_m")
    return docs.join(held, docs[key].eqNullSafe(held["_k"]) & (F.md5(F.coalesce(docs[text], F.lit(""))) == held["_m"]), "left_anti")


def covered(hits: Column) -> Column:
    """Words under the union of sorted (start, end) spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    grow = lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0), h["e"] - F.greatest(h["s"], a["to"]))).alias("n"), F.greatest(a["to"], h["e"]).alias("to"))
    return F.aggregate(hits, start, grow, lambda a: a["n"])


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(
        key,
        "n_words",
        covered(F.col("hits")).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        hex_digest(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op2_decontamination(spark, folder: str) -> DataFrame:
    """The overlap of every document with all items of ``benchmark``."""
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    return digest(find_overlap(read("documents"), read("benchmark")))


_WORDS = r"list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: true)"
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, w[i + 1:i + {WINDOW}] AS g FROM (SELECT *, unnest(range(greatest(0, len(w) - {WINDOW}) + 1)) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT len(g) AS n FROM v),
p AS (SELECT r, n, i, w[i + 1:i + n] AS g FROM (SELECT r, n, w, unnest(range(len(w) - n + 1)) AS i FROM d, l WHERE len(w) >= n)),
h AS (SELECT r, i, n, item_id FROM p JOIN v USING (g)),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""
