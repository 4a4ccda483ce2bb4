"""Rows that share a key, and rows whose id is in a set, at any size of either."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids that are broadcast at most; beyond that the same join is a shuffle.
BROADCAST_ROWS = 1 << 20
#: Texts turned into words at a time.
SLICE_ROWS = 256


def within(column: Column, ids: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Keep the rows whose ``column`` is in ``ids`` (id), distinct ones."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return lambda frame: frame.join(F.broadcast(ids) if few else ids, column == F.col("id"), "left_semi")


def by_slices(batches: Iterator[pa.RecordBatch], make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield make(batch.slice(at, SLICE_ROWS))


def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def shared_rows(rows: DataFrame, alone: int | None = None) -> DataFrame:
    """(h, n, rep, place): the rows (h, n, rep) whose key ``h`` another row has too; place counts the rows of a key by n, then rep.

    With ``alone`` set, a single row with at least that n is kept as well. A task reads its rows in order and holds
    one batch, however many rows a key has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, place = None, None, 0
        for batch in ended(batches):
            now = [] if batch is None else [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                now = held if batch is None else [np.concatenate(p) for p in zip(held, now)]
            if not now or not len(now[0]):
                continue
            h, end = now[0], len(now[0]) if batch is None else len(now[0]) - 1
            held = [c[-1:] for c in now]
            if not end:
                continue
            as_before = np.concatenate(([before is not None and h[0] == before], h[1:] == h[:-1]))
            as_next = np.concatenate((h[1:] == h[:-1], [False]))
            begin = np.maximum.accumulate(np.where(as_before, -1, np.arange(len(h))))
            places = np.where(begin < 0, place + 1 + np.arange(len(h)), np.arange(len(h)) - begin)
            keep = (as_before | as_next)[:end]
            if alone is not None:
                keep |= now[1][:end] >= alone
            before, place = h[end - 1], int(places[end - 1])
            yield pa.RecordBatch.from_arrays([pa.array(c[:end][keep]) for c in (*now, places.astype(np.int64))], ["h", "n", "rep", "place"])

    rows = rows.repartition("h").sortWithinPartitions("h", "n", "rep")
    return rows.mapInArrow(run, "h bigint, n bigint, rep bigint, place bigint")
