"""Adding up binary payloads of tasks, as tree aggregation does."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DRIVER_VALUES = 1 << 22  # doubles of all tasks that may come to the driver unadded (32 MB)


def add_payloads(parts: DataFrame, values: int) -> dict[int, np.ndarray]:
    """Sum of the doubles in `m` per `part`; `values` is how many all tasks send at most.

    Beyond the bound the parts are added by tasks first, and only their sums come to the driver.
    """
    def add(group: pa.Table) -> pa.Table:
        total = 0.0
        for m in group.column("m"):
            total = total + np.frombuffer(m.as_buffer())
        return pa.table({"part": group.column("part").slice(0, 1), "m": pa.array([total.tobytes()], pa.binary())})

    if values > DRIVER_VALUES:
        parts = parts.groupBy("part").applyInArrow(add, "part int, m binary")
    got, out = parts.toArrow(), {}
    for part, m in zip(got.column("part").to_pylist(), got.column("m")):
        out[part] = out.get(part, 0.0) + np.frombuffer(m.as_buffer())
    return out
