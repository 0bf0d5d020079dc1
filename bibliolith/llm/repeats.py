"""Plumbing shared by the two operators that remove repeated spans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import shuffle_width


def partitions_for(docs: DataFrame) -> int:
    """Reduce partitions for a pass over ``docs``: as many as it has splits, so that what a task holds doesn't grow with the table."""
    return max(shuffle_width(docs.sparkSession), docs.rdd.getNumPartitions())


def keyed(docs: DataFrame, id_col: str, text_col: str, rest: tuple[str, ...] = ()) -> DataFrame:
    """``_id, _sum, _text``: rows are told apart by id and a 64-bit hash, so that one id may come with several texts.
    ``_rest`` has the id and more columns, as they were, under names that can't clash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.xxhash64(text).alias("_sum"),
        text.alias("_text"),
        F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate([id_col, *rest])]).alias("_rest"),
    )


def grouped_slices(owner: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts items by owner (0 to parts - 1), and the parts + 1 bounds in it."""
    order = np.argsort(owner, kind="stable")
    return order, np.searchsorted(owner[order], np.arange(parts + 1))


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all items of ranges one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def stretches(flag: np.ndarray, group: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of maximal stretches of flagged items with consecutive positions in one group."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (group[at[1:]] != group[at[:-1]]) | (position[at[1:]] != position[at[:-1]] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last]
