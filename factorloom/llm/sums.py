"""Sums of fixed-size arrays that tasks send, one for each key and task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks among which the arrays of one key are dealt before what is left of them meets.
FAN = 256


def summed_arrays(parts: DataFrame, keys: list[str], value: str) -> dict[tuple, np.ndarray]:
    """For each key the elementwise sum of the arrays of doubles.

    Arrays of a key meet in two levels, first among those of every FAN-th task, so that no task reads more than
    the larger of FAN and a FAN-th of all tasks' arrays. The driver gets one for each key."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for i in range(batch.num_rows):
                key = tuple(batch.column(c)[i].as_py() for c in keys)
                array = batch.column(value)[i].values.to_numpy(zero_copy_only=False)
                if key in total:
                    total[key] += array
                else:
                    total[key] = array.copy()
        if total:
            columns = [pa.array(x, schema.field(c).type) for c, x in zip(keys, zip(*total))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], [*keys, value])

    slim = parts.select(*keys, value)
    dealt = slim.withColumn("fan", F.spark_partition_id() % FAN).repartition(*keys, "fan").select(*keys, value)
    rows = dealt.mapInArrow(task, slim.schema).repartition(*keys).mapInArrow(task, slim.schema).collect()
    return {tuple(r[k] for k in keys): np.array(r[value]) for r in rows}
