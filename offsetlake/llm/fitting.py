"""Training on a bounded sample inside one task, so that the driver holds the fitted model only."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from offsetlake.llm.blocks import release


def fit_in_task(sample: DataFrame, order: list[str], fit: Callable[[pa.Table], Any]) -> Any | None:
    """fit(rows of the sample, sorted by `order`) as computed by an executor; None for an empty sample.

    The caller bounds the sample: all of it is in this one task. A lost executor costs the task again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            model = pickle.dumps(fit(pa.Table.from_batches(held)))
            held.clear()
            release()
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    found = sample.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None
