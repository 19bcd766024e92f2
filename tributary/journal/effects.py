"""Recorded effects: outcomes are committed under a cursor and a hash of their input, and replays reuse them.

Outcomes are written to the cache first, by one committed job, and results are read from it: no result exists whose effect is not on record.
A task that is retried, or a job that fails before its commit, may call the provider again for the same row. What that means depends on the
declared safety: idempotent and at_least_once effects just run again; requires_key effects get a key that is the same on every
attempt; transactional effects run on the driver in batches, each committed before the next begins, so no task retry repeats them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FatalError
from ..functions.hashing import fingerprint, stable_hash64
from ..operators.fold import arrow_rows, arrow_schema, ordered_fold, struct_type
from ..storage import exists, materialise

#: Safe to run again, safe with a key, may run more than once, or committed with its outcome.
SAFETY = ("idempotent", "requires_key", "at_least_once", "transactional")
RECORD = "stage string, _pos long, ordinal int, input_hash string, reply string, _error_kind string, _error_message string"


def effect_key(stage: str, pos: int, ordinal: int) -> str:
    """The key of an effect: the same on every attempt."""
    return f"{stable_hash64(ordinal, f'{stage}/{pos}'.encode()):016x}"


def _call(provider: Callable, *args: str) -> tuple[str | None, str | None, str | None]:
    """Reply, error kind and message. A FatalError fails the stage."""
    try:
        return provider(*args), None, None
    except FatalError:
        raise
    except Exception as error:
        return None, getattr(error, "kind", "Remote"), str(error)


class EffectCache:
    """A table of outcomes below `path`: stage, _pos, ordinal, input_hash, reply, error."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path, read_only

    def table(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).parquet(self.path)

    def _known(self, stage: str, ordinal: int) -> DataFrame:
        rows = self.table().filter((F.col("stage") == stage) & (F.col("ordinal") == ordinal))
        # Of outcomes that were recorded twice (a job that failed after its commit was seen as lost) one counts.
        return rows.groupBy("_pos").agg(F.min(F.struct("input_hash", "reply", "_error_kind", "_error_message")).alias("_known"))

    def _append(self, rows: DataFrame) -> None:
        rows.select(*struct_type(RECORD).names).write.mode("append").parquet(self.path)

    def perform(self, df: DataFrame, stage: str, prompt: str, provider: Callable[..., str], safety: str = "idempotent", ordinal: int = 0, batch: int = 100) -> DataFrame:
        """df (with a unique _pos) and the reply of each row: recorded outcomes first, the provider for the rest.

        A recorded outcome for the same place but another input is a mismatch and fails. A read-only cache (strict replay) fails on rows
        without an outcome. provider(prompt), or provider(prompt, key) where the safety is requires_key.
        """
        if safety not in SAFETY:
            raise ValueError(f"safety is one of {SAFETY}")
        keyed = df.drop("_error_kind", "_error_message").withColumn("_hash", fingerprint(prompt))
        joined = keyed.join(self._known(stage, ordinal), "_pos", "left")
        if not joined.filter(F.col("_known").isNotNull() & (F.col("_known.input_hash") != F.col("_hash"))).isEmpty():
            raise ValueError(f"{stage}: an effect is recorded for another input")
        todo = joined.filter(F.col("_known").isNull()).select("_pos", F.col("_hash").alias("input_hash"), F.col(prompt).alias("_prompt"))
        if self.read_only:
            if not todo.isEmpty():
                raise ValueError(f"{stage}: no recorded outcome for an effect")
        elif safety == "transactional":
            self._one_by_one(todo, stage, provider, ordinal, batch)
        else:
            self._append(self._outcomes(todo, stage, provider, ordinal, safety == "requires_key"))
        done = keyed.join(self._known(stage, ordinal), "_pos")
        return done.select(*(c for c in keyed.columns if c != "_hash"), "_known.reply", "_known._error_kind", "_known._error_message")

    @staticmethod
    def _outcomes(todo: DataFrame, stage: str, provider: Callable, ordinal: int, with_key: bool) -> DataFrame:
        arrow = arrow_schema(struct_type(RECORD))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                out = []
                for row in rows.to_pylist():
                    reply, kind, message = _call(provider, row["_prompt"], *([effect_key(stage, row["_pos"], ordinal)] if with_key else []))
                    out.append({"stage": stage, "_pos": row["_pos"], "ordinal": ordinal, "input_hash": row["input_hash"], "reply": reply, "_error_kind": kind, "_error_message": message})
                yield arrow_rows(out, arrow)

        return todo.mapInArrow(run, RECORD)

    def _one_by_one(self, todo: DataFrame, stage: str, provider: Callable, ordinal: int, batch: int) -> None:
        held: list[tuple] = []

        def commit() -> None:
            if held:
                self._append(self.spark.createDataFrame(held, RECORD))
                held.clear()

        for row in materialise(todo, "todo").orderBy("_pos").toLocalIterator():
            try:
                held.append((stage, row["_pos"], ordinal, row["input_hash"], *_call(provider, row["_prompt"])))
            except FatalError:
                commit()  # what was done stays on record
                raise
            if len(held) >= batch:
                commit()
        commit()


def pending(df: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows of df (by _pos) that have no outcome yet."""
    return df.join(outcomes.select("_pos").distinct(), "_pos", "left_anti")


class Decider:
    """An effectful stateful stage: decide(state, row) gives a prompt (None: no effect); the effect's outcome is a fact; apply(state, row, reply, error) gives
    the new state and output rows. Only the provider does I/O, and decide and apply are pure, so a replay repeats them exactly."""

    def initial(self) -> object:
        raise NotImplementedError

    def decide(self, state: object, row: dict) -> str | None:
        raise NotImplementedError

    def apply(self, state: object, row: dict, reply: str | None, error: str | None) -> tuple[object, Iterable[dict]]:
        raise NotImplementedError


def effectful_stateful(cache: EffectCache, df: DataFrame, stage: str, decider: Decider, provider: Callable[[str], str], schema: T.StructType | str, keys: Sequence[str], order: str = "_pos") -> DataFrame:
    """Output rows of the decider over df (with a unique _pos) in order, per key.

    Outcomes on record are used instead of the provider; new ones are on record before this returns. A read-only cache refuses what is not on record, and a
    recorded outcome of another prompt fails.
    """
    kind, record = struct_type(schema), struct_type(RECORD)
    both = T.StructType([T.StructField("_out", kind), T.StructField("_record", record)])
    known = cache._known(stage, 0)
    rows = df.join(known, "_pos", "left")
    read_only = cache.read_only

    def step(state, row):
        known = row.pop("_known")
        prompt, reply, error, done = decider.decide(state, row), None, None, []
        if prompt is not None:
            hashed = f"{stable_hash64(0, prompt.encode()):016x}"
            if known is not None:
                if known["input_hash"] != hashed:
                    raise FatalError(f"{stage}: an effect is recorded for another input")
                reply, error = known["reply"], known["_error_kind"]
            elif read_only:
                raise FatalError(f"{stage}: no recorded outcome for an effect")
            else:
                reply, error, message = _call(provider, prompt)
                done = [{"_record": {"stage": stage, "_pos": row["_pos"], "ordinal": 0, "input_hash": hashed, "reply": reply, "_error_kind": error, "_error_message": message}}]
        state, facts = decider.apply(state, row, reply, error)
        return state, [*done, *({"_out": fact} for fact in facts)]

    ran = materialise(ordered_fold(rows, keys, order, decider.initial, step, both), "decided")
    if not read_only:
        cache._append(ran.filter("_record is not null").select("_record.*"))
    return ran.filter("_out is not null").select("_out.*")


def recorded(cache: EffectCache, stage: str) -> list[Row]:
    """Outcomes of a stage, for small stages and tests."""
    return cache.table().filter(F.col("stage") == stage).orderBy("_pos", "ordinal").collect()
