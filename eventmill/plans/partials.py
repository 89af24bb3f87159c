"""Arrays that every task sums for itself, added as a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Rows of each key at the levels of the tree; the last level reaches the driver.
LEVELS = (1024, 16)


def key_of(value: Any) -> Any:
    """A key of a pandas group; a missing one is None."""
    return None if value is None or value != value else value


def summed_arrays(rows: DataFrame, key: str, measure: Callable[[Any, pd.DataFrame], np.ndarray | None], levels: tuple[int, ...] = LEVELS) -> dict[Any, np.ndarray]:
    """For each value of ``key`` the sum of ``measure(value, rows)`` over all batches; keys and arrays are few and of fixed size.

    A task holds one array a key and hands on one row a key.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, __part int, __shape string, __sum binary"

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[Any, np.ndarray] = {}
        for b in batches:
            for value, own in b.groupby(key, dropna=False):
                got = measure(key_of(value), own)
                if got is not None:
                    held[key_of(value)] = held.get(key_of(value), 0) + got.astype(float)
        part = TaskContext.get().partitionId()
        yield pd.DataFrame([(k, part, ",".join(map(str, v.shape)), v.tobytes()) for k, v in held.items()], columns=[key, "__part", "__shape", "__sum"])

    def added(few: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in few["__sum"])
        return few.iloc[:1].assign(__sum=[total.tobytes()])

    parts = rows.mapInPandas(counted, schema)
    for n in levels:
        parts = parts.groupBy(key, (F.col("__part") % n).alias("__few")).applyInPandas(added, schema)
    out: dict[Any, np.ndarray] = {}
    for r in parts.toLocalIterator():  # the last level's rows of each key
        out[r[key]] = out.get(r[key], 0) + np.frombuffer(r["__sum"]).reshape([int(n) for n in r["__shape"].split(",")])
    return out
