"""Work on one column in Arrow batches that are cut by size, with the other columns passed through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` together; a larger row is alone or ends its range."""
    if len(sizes) == 0:
        return
    group = np.cumsum(sizes) // limit
    cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(sizes)]
    yield from ((int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def sizes_of(values: pa.Array) -> np.ndarray:
    if pa.types.is_list(values.type):
        return np.array(pc.list_value_length(values).fill_null(0), np.int64) * 4
    return np.array(pc.binary_length(values).fill_null(0), np.int64)


def append(df: DataFrame, column: str, fields: list[T.StructField], work: Callable[[pa.Array], list[pa.Array]], limit: int) -> DataFrame:
    """Add output columns made from one column. An output column replaces an input column of its name."""
    names = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name not in names]
    n = len(kept)
    # work names, so that no column of the caller clashes
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*kept, *fields])])
    given = lambda name: df["`" + name.replace("`", "``") + "`"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(n)
            for a, z in slices(sizes_of(values), limit):
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(a, z - a) for i in range(n)], *work(values.slice(a, z - a))], schema.names)

    source = df.select(*[given(f.name).alias(f"c{i}") for i, f in enumerate(kept)], given(column).alias(f"c{n}"))
    return source.mapInArrow(run, schema).toDF(*[f.name for f in kept], *names)


def by_character(flat: np.ndarray, kind: Callable[[str], int]) -> np.ndarray:
    """A small number for each of an array of code points, asked for once per distinct character."""
    used = np.flatnonzero(np.bincount(flat))
    table = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.uint8)
    table[used] = [kind(chr(c)) for c in used.tolist()]
    return table[flat]
