"""CSV and TSV sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cell(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.StructType | T.ArrayType | T.MapType):
        return F.coalesce(F.to_json(name), F.lit(""))
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


class CsvSink:
    """One directory of CSV files. Columns default to the payload's, sorted; others than the chosen are ignored, missing ones are
    empty. Null is empty, numbers and booleans text, nested values JSON. single_file orders rows by `order` in one file:
    for exports that one task can write; else partitions are written in parallel, range-partitioned by `order`."""

    redelivery = "duplicate_sensitive"

    def __init__(self, path: str, columns: Sequence[str] | None = None, headers: Sequence[str] | None = None, sep: str = ",", append: bool = False, single_file: bool = False):
        if headers is not None and (columns is None or len(headers) != len(columns)):
            raise ValueError("headers need columns of the same number")
        self.path, self.columns, self.headers, self.sep, self.append, self.single_file = path, columns, headers, sep, append, single_file

    def write(self, df: DataFrame, order: str | None = None) -> None:
        columns = list(self.columns or sorted(c for c in df.columns if not c.startswith("_")))
        names = list(self.headers or columns)
        cells = [(_cell(df, c) if c in df.columns else F.lit("")).alias(n) for c, n in zip(columns, names, strict=True)]
        if order:
            df = df.repartition(1).sortWithinPartitions(order) if self.single_file else df.repartitionByRange(order).sortWithinPartitions(order)
        elif self.single_file:
            df = df.coalesce(1)
        writer = df.select(*cells).write.mode("append" if self.append else "overwrite")
        writer.option("header", True).option("sep", self.sep).option("emptyValue", "").option("nullValue", "").csv(self.path)


class TsvSink(CsvSink):
    def __init__(self, path: str, **options):
        super().__init__(path, sep="\t", **options)
