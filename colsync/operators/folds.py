"""Sequential folds: what depends on each row before it, a key after the other, in bounded memory.

Rows of a key are sorted by Spark, which spills, and stream through a task by
batch; only the state of the key at hand is held, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def edges(rows: pd.DataFrame, keys: list[str]) -> list[int]:
    """Where neighbours differ in a key, with both ends; null equals null."""
    change = np.zeros(max(len(rows) - 1, 0), bool)
    for k in keys:
        value, null = rows[k].to_numpy(), rows[k].isna().to_numpy()
        change |= (null[1:] != null[:-1]) | (~null[1:] & (value[1:] != value[:-1]))
    return [0, *(np.flatnonzero(change) + 1).tolist(), len(rows)]


def fold_sorted(df: DataFrame, by: list[str], order: list[str], start: Callable, step: Callable, result: Callable, fields: str) -> DataFrame:
    """A row for each key: ``*by`` and the ``fields`` (a schema) that ``result(state)`` gives.

    ``start()`` makes a state; ``step(state, rows)`` takes the next rows of the key.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in by), fields])
    names = [*(f.name for f in df.schema if f.name in by), *(f.split()[0] for f in fields.split(","))]
    keys = names[: len(by)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, done = None, None, []
        for rows in batches:
            cut = edges(rows, keys)
            for a, b in zip(cut, cut[1:], strict=False):
                if a == b:
                    continue
                now = tuple(None if pd.isna(x) else x for x in (rows[k].iloc[a] for k in keys))
                if state is None or now != key:
                    if state is not None:
                        done.append((*key, *result(state)))
                    key, state = now, start()
                step(state, rows.iloc[a:b])
            if done:
                yield pd.DataFrame(done, columns=names)
                done = []
        if state is not None:
            yield pd.DataFrame([(*key, *result(state))], columns=names)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)
