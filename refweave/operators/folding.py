"""Folds in order over sorted rows: what a window can't say because the next state depends on what was decided before."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

#: (state, row) to the next state and the values that the row gives, or None for nothing.
Step = Callable[[Any, tuple], tuple[Any, tuple | None]]


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Any, step: Step, gives: str, spread: bool = False) -> DataFrame:
    """keys and the values that `step` gives for the rows of each key in order; `gives` is their schema, and rows reach `step` as tuples of all columns.

    Rows are dealt out by key and sorted within partitions by Spark, which spills; a task goes through them once and holds one state, however long a key is. `start` is a value that isn't changed in place, or a function that makes one.
    `spread` keeps all shuffle partitions, where a row takes far more time than its bytes tell; otherwise adaptive execution puts small ones together.
    """
    names = df.columns
    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + [gives])
    at = [names.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        columns = keys + [c.split()[0] for c in gives.split(", ")]
        for b in batches:
            out = []
            for row in zip(*(b[c].tolist() for c in names)):
                key = tuple(row[i] for i in at)
                if last is None or key != last:
                    last, state = key, start() if callable(start) else start
                state, values = step(state, row)
                if values is not None:
                    out.append((*key, *values))
            yield pd.DataFrame(out, columns=columns)

    by = [int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if spread else []
    return df.repartition(*by, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
