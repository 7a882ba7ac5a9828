"""Names of columns: fresh ones, and the caller's own whatever they are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.memory import returning


def fresh(taken: Sequence[str], *wanted: str) -> list[str]:
    """``wanted`` names, with underscores added until none is among ``taken`` (in any case)."""
    low, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def named(name: str) -> Column:
    """The column of exactly this name, points and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def own(df: DataFrame, *replaced: str) -> list[str]:
    """The names of ``df``'s columns but those (in any case) that an operator replaces."""
    low = {r.lower() for r in replaced}
    return [c for c in df.columns if c.lower() not in low]


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow``, also where names hold points: Spark sees numbered columns, ``run`` the caller's."""
    names = df.columns

    def under_own_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(returning(under_own_names), schema)
