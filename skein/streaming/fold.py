"""Order-dependent operators as folds of small state machines: one definition, run in batch and on a stream.

A machine has ``output`` (DDL of its output rows), ``start()``, ``step(state, row)`` and ``finish(state)``;
states are JSON values, steps return the new state and output tuples. In batch, rows are sorted by
key and order and pass through in order, so only the state of the key at hand is held. On a stream,
the state of each key is kept by Spark; a key's rows of a trigger are sorted, and those older than
the last one seen are late and dropped. Both give the same rows for the same ordered input.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


class Machine(Protocol):
    output: str

    def start(self) -> Any: ...

    def step(self, state: Any, row: dict) -> tuple[Any, list[tuple]]: ...

    def finish(self, state: Any) -> list[tuple]: ...


def _schema(rows: DataFrame, key: list[str], machine: Machine) -> StructType:
    return StructType([*[StructField(k, rows.schema[k].dataType) for k in key], *StructType.fromDDL(machine.output).fields])


def fold(rows: DataFrame, key: list[str], order: list[str], machine: Machine) -> DataFrame:
    """The machine's output over each key's rows in order, with what is open at the end."""
    kind, width = _schema(rows, key, machine), len(key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, None
        for frame in frames:
            out: list[tuple] = []
            names = list(frame.columns)
            for values in frame.itertuples(index=False, name=None):
                now = values[:width]
                if held != now:
                    if held is not None:
                        out += [(*held, *o) for o in machine.finish(state)]
                    held, state = now, machine.start()
                state, made = machine.step(state, dict(zip(names, values)))
                out += [(*now, *o) for o in made]
            yield pd.DataFrame(out, columns=kind.names)
        if held is not None:
            yield pd.DataFrame([(*held, *o) for o in machine.finish(state)], columns=kind.names)

    first = rows.select(*key, *[c for c in rows.columns if c not in key])
    return first.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, kind)


def fold_stream(rows: DataFrame, key: list[str], order: str, machine: Machine, timeout_ms: int) -> DataFrame:
    """The machine over a stream; a key that is silent for ``timeout_ms`` of processing time is finished."""
    kind, width = _schema(rows, key, machine), len(key)

    def run(name: tuple, frames: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        if store.hasTimedOut:
            state = json.loads(store.get[0])
            store.remove()
            yield pd.DataFrame([(*name, *o) for o in machine.finish(state["state"])], columns=kind.names)
            return
        state = json.loads(store.get[0]) if store.exists else {"state": machine.start(), "last": None}
        frame = pd.concat(list(frames)).sort_values(order, kind="stable")
        out: list[tuple] = []
        names = list(frame.columns)
        for values in frame.itertuples(index=False, name=None):
            row = dict(zip(names, values))
            if state["last"] is not None and row[order] < state["last"]:
                continue
            state["last"] = row[order] if not hasattr(row[order], "item") else row[order].item()
            state["state"], made = machine.step(state["state"], row)
            out += [(*name, *o) for o in made]
        store.update((json.dumps(state),))
        store.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=kind.names)

    grouped = rows.select(*key, *[c for c in rows.columns if c not in key]).groupBy(*key)
    return grouped.applyInPandasWithState(run, kind, "state string", "append", "ProcessingTimeTimeout")
