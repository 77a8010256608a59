"""The command log as a stream: each key's store is state, kept between batches."""

from __future__ import annotations

import math
import pickle
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.keyed import Store


def respond(log: DataFrame, idle_seconds: int | None = None) -> DataFrame:
    """Rows (seq, ok, message, value) for a streamed log (columns as in operators.keyed.LOG).

    State is a key's value and expiry. A key whose expiry has passed answers as absent; with `idle_seconds`, state of
    keys without commands for that long is dropped when they have expired.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        store = Store(time.time)
        if state.exists:
            store.data, store.expiry = pickle.loads(state.get[0])
        if state.hasTimedOut:
            if store.kind(key[0]) is None:
                state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for r in rows.to_dict("records"):
            c = {k: v for k, v in r.items() if not (v is None or isinstance(v, float) and math.isnan(v))}
            c["values"] = list(c["values"]) if c.get("values") is not None else None
            c["pairs"] = dict(c["pairs"]) if c.get("pairs") is not None else None
            got = store.run(c)
            out.append((r["seq"], got["ok"], got["message"], got["value"]))
        state.update((pickle.dumps((store.data, store.expiry)),))
        if idle_seconds:
            state.setTimeoutDuration(idle_seconds * 1000)
        yield pd.DataFrame(out, columns=["seq", "ok", "message", "value"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_seconds else GroupStateTimeout.NoTimeout
    return log.groupBy("key").applyInPandasWithState(run, "seq long, ok boolean, message string, value string", "state binary", "append", timeout)
