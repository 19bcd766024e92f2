"""Typed rows: event types, versions and the schemas that stages declare."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Envelope columns start with this, so user columns stay flat and prunable.
ENVELOPE = "_"


@dataclass(frozen=True)
class EventType:
    """A row type: stable name, schema version and the columns of its payload."""

    name: str
    schema: T.StructType
    version: int = 1

    def __post_init__(self):
        if not self.name or self.version < 1:
            raise ValueError("an event type needs a name, and a version from 1 up")

    @property
    def versioned(self) -> str:
        return f"{self.name}.v{self.version}"

    def matches(self, event_type: Column) -> Column:
        """Rows of this type: the bare name or the current version's name, no other version."""
        return event_type.isin(self.name, self.versioned)

    def decode(self, df: DataFrame, payload: str = "payload", event_type: str = "event_type") -> DataFrame:
        """Rows of this type from JSON payloads: payload columns, with _error_kind where decoding failed."""
        parsed = F.from_json(F.col(payload), _nullable(self.schema), {"mode": "PERMISSIVE"})
        mine = df.filter(self.matches(F.col(event_type))).withColumn("_parsed", parsed)
        required = [f.name for f in self.schema.fields if not f.nullable]
        sound = F.col("_parsed").isNotNull() & F.try_parse_json(F.col(payload)).isNotNull()
        for name in required:
            sound = sound & F.col(f"_parsed.{name}").isNotNull()
        kept = [c for c in df.columns if c not in (payload, event_type)]
        return mine.select(*kept, *(F.col(f"_parsed.{f.name}").alias(f.name) for f in self.schema.fields), F.when(sound, F.lit(None)).otherwise("Deserialization").alias("_error_kind"))


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


@dataclass
class Registry:
    """Known event types. A name has one schema per version; a change that is not additive needs a new name."""

    types: dict[tuple[str, int], EventType] = field(default_factory=dict)

    def add(self, kind: EventType) -> EventType:
        old = self.types.get((kind.name, kind.version))
        if old and old.schema != kind.schema:
            raise ValueError(f"{kind.versioned} is registered with another schema")
        before = self.types.get((kind.name, kind.version - 1))
        if before:
            now = {f.name: f.dataType for f in kind.schema.fields}
            gone = [f.name for f in before.schema.fields if now.get(f.name) != f.dataType]
            if gone:
                raise ValueError(f"{kind.versioned} drops or changes {gone}: that needs a new name")
        self.types[(kind.name, kind.version)] = kind
        return kind

    def get(self, name: str) -> EventType | None:
        """By bare name (latest version) or versioned name of the latest version."""
        versions = [v for n, v in self.types if n == name]
        if versions:
            return self.types[(name, max(versions))]
        return next((k for k in self.types.values() if k.versioned == name and not any(o.name == k.name and o.version > k.version for o in self.types.values())), None)


def payload_schema(df: DataFrame) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if not f.name.startswith(ENVELOPE)])


def check_schema(df: DataFrame, declared: T.StructType, where: str) -> None:
    """Raise TypeError unless df has the declared columns with the declared types, in any order."""
    have = {f.name: f.dataType for f in payload_schema(df).fields}
    wrong = [f"{f.name}: {have.get(f.name, 'missing')} for {f.dataType}" for f in declared.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise TypeError(f"{where}: {'; '.join(map(str, wrong))}")
