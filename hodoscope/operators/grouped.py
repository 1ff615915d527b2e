"""Grouped Python work over many small groups: whole groups come in large frames, so the work can be vectorised across them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def map_whole_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: StructType | str, order: list[str] | None = None, least_rows: int = 0) -> DataFrame:
    """fn(frame, group numbers) on frames that hold only whole groups of keys, sorted by keys and order.

    A group must fit in memory; a thousand small ones cost one call. Groups are gathered until they have least_rows rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for frame in frames:
            if not len(frame):
                continue
            last = frame[keys].iloc[-1]
            same = (frame[keys] == last).all(axis=1).to_numpy()
            start = len(frame) - int(np.argmax(~same[::-1])) if not same.all() else 0
            ends = start > 0 or (held and not (held[-1][keys].iloc[-1] == last).all())  # a group ends at start
            if ends and rows + start >= least_rows:
                yield done(pd.concat([*held, frame.iloc[:start]]))
                held, rows, frame = [], 0, frame.iloc[start:]
            held.append(frame)
            rows += len(frame)
        if held:
            yield done(pd.concat(held))

    def done(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.reset_index(drop=True)
        new = (frame[keys] != frame[keys].shift()).any(axis=1)
        return fn(frame, new.cumsum().to_numpy() - 1)

    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInPandas(run, schema)


def component_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's connected component, for edges a-b among 0..n-1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            break
    return label
