"""Handlers with their own state: custom stateful stages and custom joins, as ordered folds.

A handler is a class whose instances travel to the executors; state is whatever its initial() gives. Keyed handlers run in parallel over keys
with one key's state in memory; without keys there is one sequence (see fold).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ok_rows
from ..order import seconds as time_seconds
from .fold import ordered_fold

#: What becomes of the state after an emission.
RETAIN, RESET = "retain", "reset"


class StatefulHandler:
    """accumulate(state, row) gives the new state; should_emit decides by the state itself; emit gives rows and what becomes of the state.

    emit_interval: seconds of `ts` after which a row emits in any case (None: never). drain gives rows at the end of a key.
    """

    emit_interval: float | None = None

    def initial(self) -> object:
        raise NotImplementedError

    def accumulate(self, state: object, row: dict) -> object:
        raise NotImplementedError

    def should_emit(self, state: object) -> bool:
        return False

    def emit(self, state: object) -> tuple[Iterable[dict], str]:
        return (), RETAIN

    def drain(self, state: object) -> Iterable[dict]:
        return ()


def stateful(df: DataFrame, handler: StatefulHandler, schema: T.StructType | str, keys: Sequence[str] = (), order: str = "_seq", ts: str | None = None) -> DataFrame:
    """Rows that the handler emits over df in order, independent per key. Marked rows are left out."""
    if handler.emit_interval is not None and not ts:
        raise ValueError("an emit interval needs a time column")
    rows = ok_rows(df).withColumn("_handler_ts", time_seconds(df, ts) if ts else F.lit(0.0))

    def step(state, row):
        kept, since = state
        now = row.pop("_handler_ts")
        since = now if since is None else since
        kept = handler.accumulate(kept, row)
        due = handler.emit_interval is not None and now - since >= handler.emit_interval
        if not (due or handler.should_emit(kept)):
            return (kept, since), ()
        out, then = handler.emit(kept)
        if then not in (RETAIN, RESET):
            raise ValueError(f"after an emission the state is {RETAIN} or {RESET}, not {then!r}")
        return (kept if then == RETAIN else handler.initial(), None), out

    return ordered_fold(rows, keys, order, lambda: (handler.initial(), None), step, schema, lambda state: handler.drain(state[0]))


class JoinHandler:
    """A join with its own state per key: it sees reference and stream rows in arrival order, the reference first at ties.

    admit says whether a reference row enters; on_reference and on_stream give the new state and output rows; on_stream_eof gives rows when the stream of a key has
    ended, and drain at the very end.
    """

    def initial(self) -> object:
        raise NotImplementedError

    def admit(self, row: dict) -> bool:
        return True

    def on_reference(self, state: object, row: dict) -> tuple[object, Iterable[dict]]:
        raise NotImplementedError

    def on_stream(self, state: object, row: dict) -> tuple[object, Iterable[dict]]:
        raise NotImplementedError

    def on_stream_eof(self, state: object) -> Iterable[dict]:
        return ()

    def drain(self, state: object) -> Iterable[dict]:
        return ()


def join(reference: DataFrame, stream: DataFrame, handler: JoinHandler, schema: T.StructType | str, ref_key: Sequence[str], stream_key: Sequence[str], ref_order: str, stream_order: str, finite: bool = False) -> DataFrame:
    """Rows that the handler emits. finite: a key's whole reference comes before its stream (else both come as they arrived)."""
    if len(ref_key) != len(stream_key):
        raise ValueError("both sides need the same number of key columns")

    def side(df: DataFrame, keys: Sequence[str], order: str, number: int) -> DataFrame:
        named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
        return ok_rows(df).select(*named, F.col(order).alias("_o"), F.lit(number).alias("_side"), F.struct(*df.columns).alias("ref" if number == 0 else "stream"))

    both = side(reference, ref_key, ref_order, 0).unionByName(side(stream, stream_key, stream_order, 1), allowMissingColumns=True)

    def step(state, row):
        kept, in_stream = state
        if row["_side"] == 0:
            out = handler.on_reference(kept, row["ref"]) if handler.admit(row["ref"]) else (kept, ())
        else:
            out = handler.on_stream(kept, row["stream"])
        return (out[0], in_stream or row["_side"] == 1), out[1]

    def finish(state):
        yield from handler.on_stream_eof(state[0]) if state[1] else ()
        yield from handler.drain(state[0])

    return ordered_fold(both, [f"_k{i}" for i in range(len(ref_key))], ["_side", "_o"] if finite else ["_o", "_side"], lambda: (handler.initial(), False), step, schema, finish)
