"""What the stateful streams share: the state store, and rows of a micro-batch in order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, on the executors' disks with its
    changes in the checkpoint: state may outgrow memory, and typed state needs it."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def in_order(parts: list[pd.DataFrame], order: Sequence[str]) -> list[tuple[int, int]]:
    """(part, row) of the rows of all parts in ``order``: only the order columns are put
    together, the parts stay as they came."""
    keys = pd.concat([p[list(order)] for p in parts], ignore_index=True)
    at = keys.sort_values(list(order), kind="stable").index.to_numpy()
    ends = np.cumsum([len(p) for p in parts])
    part = np.searchsorted(ends, at, side="right")
    starts = ends - [len(p) for p in parts]
    return list(zip(part.tolist(), (at - starts[part]).tolist()))
