"""The greedy plan as a stream: tensors arrive, and each is attached to the nearest base that its group has opened so far, or opens one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import planner

STATE = "ids array<long>, sketches array<array<int>>"


def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, threshold: float = 0.70) -> Iterator[pd.DataFrame]:
    """One group's micro-batch in order of arrival. State: the opened bases."""
    ids, sketches = (list(x) for x in state.get) if state.exists else ([], [])
    rows = pd.concat(list(batches)).sort_values(["ord", "tensor_id"])
    out = []
    for r in rows.itertuples(index=False):
        s = None if r.sketch is None else np.asarray(r.sketch, np.int64)
        if s is None:
            out.append((key[0], int(r.tensor_id), "skipped", None, None, None))
            continue
        plan = ("base", None, None, None)
        if sketches:
            x = np.asarray(sketches, np.int64) - s
            dist = np.einsum("ij,ij->i", x, x) / 2 / max(int(r.n_bits), 1)
            j = int(dist.argmin())
            cr = float(planner.ratios(dist[j : j + 1])[0])
            if cr <= threshold:
                plan = ("delta", j, float(dist[j]), cr)
        if plan[0] == "base":
            ids.append(int(r.tensor_id))
            sketches.append([int(v) for v in s])
        out.append((key[0], int(r.tensor_id), plan[0], None if plan[1] is None else ids[plan[1]], plan[2], plan[3]))
    state.update((ids, sketches))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in planner.PLAN_SCHEMA.split(", ")])


def attach_stream(tensors: DataFrame) -> DataFrame:
    """tensors: a stream of (group_key, ord, tensor_id, sketch, n_bits)"""
    step.__annotations__ = {}
    return tensors.groupBy("group_key").applyInPandasWithState(step, planner.PLAN_SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)
