"""Ordered folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay_columns(ops: DataFrame) -> DataFrame:
    """table, column, value: the last state of each column after create, add, change and remove in order.

    Without renames the last operation of a column decides, so no fold is needed.
    """
    last = ops.groupBy("table", "column").agg(F.max_by(F.struct("kind", "value"), "ord").alias("x"))
    return last.where("x.kind <> 'remove'").select("table", "column", F.col("x.value").alias("value"))


def replay_with_renames(ops: DataFrame) -> DataFrame:
    """table, column, value, uncertain after all operations, renames included (T1); one table's operations are one group."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        state: dict[str, object] = {}
        doubt: set[str] = set()
        for op in rows.sort_values("ord").itertuples(index=False):
            kind, column, target = op.kind, op.column, op.replacement
            if kind == "rename":
                held = state.pop(column, None)
                doubt.discard(column)
                if target in state or held is None:
                    doubt.add(target)
                else:
                    state[target] = held
            elif kind == "remove":
                state.pop(column, None)
                doubt.discard(column)
            elif kind == "add" and column in state:
                doubt.add(column)
            else:
                state[column] = op.value
                doubt.discard(column)
        names = sorted(set(state) | doubt)
        return pd.DataFrame({"table": [rows["table"].iloc[0]] * len(names), "column": names, "value": [state.get(n) for n in names], "uncertain": [n in doubt for n in names]})

    return ops.select("table", "ord", "kind", "column", "replacement", "value").groupBy("table").applyInPandas(fold, "table string, column string, value string, uncertain boolean")


def ledger_state(events: DataFrame) -> DataFrame:
    """execution, state, revision: the last state and the number of events."""
    return events.groupBy("execution").agg(F.max_by("state", "ord").alias("state"), F.count("*").alias("revision"))
