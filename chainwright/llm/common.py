"""Small column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of a block in ``starts``.
BLOCK = 256


def attach(df: DataFrame, names: list[str]) -> DataFrame:
    """The input row as one struct ``_row`` beside the named columns as ``_0``, ``_1``, ...

    Work columns can then not clash with columns of the caller.
    """
    return df.select(F.struct("*").alias("_row"), *[df[n].alias(f"_{i}") for i, n in enumerate(names)])


def release(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The rows of ``attach`` with new columns; a new column replaces one of the same name."""
    kept = [f.name for f in df.schema["_row"].dataType.fields if f.name not in columns]
    return df.select(*[F.col("_row").getField(n).alias(n) for n in kept], *[c.alias(n) for n, c in columns.items()])


def _running(lengths: Column) -> Column:
    """Exclusive running sums of a short array, with the total as last element."""
    return F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def starts(df: DataFrame, lengths: str, out: str) -> DataFrame:
    """Exclusive running sums of the array column ``lengths``.

    A row-wise fold that appends to an array copies it each time. Sums inside blocks and
    then over blocks keep that cost small for texts with very many pieces.
    """
    n = F.size(lengths)
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))), lambda b: F.slice(F.col(lengths), b * BLOCK + 1, BLOCK)
    )
    df = df.withColumn("_sums", F.transform(blocks, _running))
    df = df.withColumn("_offsets", _running(F.transform("_sums", lambda s: F.element_at(s, -1))))
    placed = F.transform("_sums", lambda s, i: F.transform(F.slice(s, 1, F.size(s) - 1), lambda x: x + F.get("_offsets", i)))
    return df.withColumn(out, F.flatten(placed)).drop("_sums", "_offsets")


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else; texts in ASCII take the faster function."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def hex_digest(text: Column) -> Column:
    return F.sha2(text, 256)
