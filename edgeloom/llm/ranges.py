"""Running sums over groups of rows in order, without a task that sees a whole group.

Rows are range-sorted, so that a group that holds many rows spans several partitions. Each partition sums
its own rows; what a group has in the partitions before is carried from one row a partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from edgeloom.llm.common import cut

PART = "part__"


def range_sorted(rows: DataFrame, *keys) -> DataFrame:
    """rows in the order of keys, by range, with their partition's number in part__; checkpointed."""
    return cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(PART, F.spark_partition_id().cast("long")))


def _runs(group: np.ndarray) -> np.ndarray:
    """Where each run of equal entries starts."""
    return np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)


def _within(values: np.ndarray, starts: np.ndarray, before: int) -> np.ndarray:
    """Running sums anew from each start; the first run goes on from before. All modulo 2**64."""
    total = np.cumsum(values.view(np.uint64), dtype=np.uint64)
    base = np.concatenate((np.array([np.uint64(-before & 0xFFFFFFFFFFFFFFFF)]), total[starts[1:] - 1]))
    return (total - np.repeat(base, np.diff(np.append(starts, len(values))))).view(np.int64)


def borders(rows: DataFrame, group: str, values: tuple[str, ...] = ()) -> list[dict]:
    """For each partition of rows (as range_sorted leaves them), in order: its first and last group and that last group's sums here.

    One row a partition reaches the driver.
    """

    def run(batches):
        part, first, last, sums, alone = None, None, None, [0] * len(values), True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(1).to_numpy()
            if part is None:
                part, first, last = batch.column(0)[0].as_py(), int(keys[0]), int(keys[0])
            start = int(_runs(keys)[-1])
            if start or int(keys[0]) != last:  # a group ends within this batch or at its start
                sums, alone = [0] * len(values), False
            last = int(keys[-1])
            for k in range(len(values)):
                sums[k] += int(np.sum(batch.column(2 + k).to_numpy()[start:].view(np.uint64), dtype=np.uint64))
        if part is not None:
            signed = [((s + (1 << 63)) % (1 << 64)) - (1 << 63) for s in sums]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, first, last, int(alone), *signed)], names=["part", "first", "last", "alone", *values])

    found = rows.select(PART, F.col(group).cast("long").alias(group), *values).mapInArrow(run, "part long, first long, last long, alone long" + "".join(f", {v} long" for v in values))
    return sorted((r.asDict() for r in found.collect()), key=lambda r: r["part"])


def running(rows: DataFrame, group: str, sums: dict[str, object], extra: dict[str, object] | None = None) -> DataFrame:
    """rows (as range_sorted leaves them) with the running sum of each column of sums (name: long column) within group, this row's included.

    Sums are taken modulo 2**64, so that they also serve as hashes; values are never null. The rows keep their
    partitions and order. A job runs when this is called, to find what each partition's first group has before it.
    """
    names = tuple(sums)
    ready = rows.select("*", *[F.col(c).alias(f"{n}__") if isinstance(c, str) else c.cast("long").alias(f"{n}__") for n, c in sums.items()])
    fields = tuple(f"{n}__" for n in names)
    carry, held, at = {}, None, [0] * len(names)
    for r in borders(ready, group, fields):
        if r["first"] != held:
            at = [0] * len(names)
        carry[r["part"]] = list(at)
        own = [r[f] for f in fields]
        at = [(a + b) % (1 << 64) for a, b in zip(at, own, strict=True)] if r["alone"] and r["first"] == held else own
        held = r["last"]
    where, wide = ready.columns.index(group), ready.columns.index(PART)
    places = [ready.columns.index(f) for f in fields]
    kept = [k for k, c in enumerate(ready.columns) if c not in fields]
    out_names = [*(ready.columns[k] for k in kept), *names]

    def run(batches):
        last, before = None, [0] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(where).to_numpy()
            if last is None:
                last, before = int(keys[0]), carry[batch.column(wide)[0].as_py()]
            elif int(keys[0]) != last:
                before = [0] * len(names)
            starts = _runs(keys)
            out = [_within(batch.column(p).to_numpy(), starts, b) for p, b in zip(places, before, strict=True)]
            last, before = int(keys[-1]), [int(x[-1]) for x in out]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *(pa.array(x) for x in out)], names=out_names)

    schema = StructType([*(ready.schema.fields[k] for k in kept), *(StructField(n, LongType()) for n in names)])
    return ready.mapInArrow(run, schema)
