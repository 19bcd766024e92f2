"""CSV and TSV sources with separate lanes for rows that do not decode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import KIND, MESSAGE, Lanes, route
from ..order import number_rows


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    first = spark.read.option("sep", sep).option("inferSchema", False).csv(path).limit(1).collect()
    return [] if not first else [c if c is not None else "" for c in first[0]]


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    headers: Sequence[str] | None = None,
    sep: str = ",",
    skip_rows: int = 0,
    select_columns: Sequence[str] | None = None,
    stop_at_structural_error: bool = True,
) -> Lanes:
    """Rows of a CSV file, by header name.

    headers: column names where the file has no header row. schema: declared types, decoded by name; without it every
    column is a string. A cell that is missing is '' in the untyped form and null in the typed one. skip_rows counts data rows
    after the header. Rows that do not decode go to the error lane and the scan continues; a row with
    more cells than columns is structural: it is reported and, by default, ends the input.
    """
    names = list(headers) if headers is not None else _header(spark, path, sep)
    wanted = list(select_columns or (schema.names if schema else names))
    unknown = [c for c in wanted if c not in names]
    if unknown:
        raise ValueError(f"columns {unknown} are not among {names}")
    raw_type = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("_corrupt", T.StringType())])
    reader = spark.read.schema(raw_type).option("sep", sep).option("header", headers is None).option("enforceSchema", True)
    raw = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    # The file's own order: its name, then the place of the row within it.
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    rows = number_rows(placed, ["_file", "_block", "_at"], "_seq")
    if skip_rows:
        rows = rows.filter(F.col("_seq") > skip_rows)
    cells = F.size(F.split("_corrupt", sep.replace("|", "\\|"), -1))
    structural = F.col("_corrupt").isNotNull() & (cells > len(names))
    if stop_at_structural_error:
        first = rows.filter(structural).agg(F.min("_seq").alias("_stop"))
        rows = rows.crossJoin(F.broadcast(first)).filter(F.col("_stop").isNull() | (F.col("_seq") <= F.col("_stop"))).drop("_stop")
    kind, message = F.when(structural, F.lit("Deserialization")), F.when(structural, F.lit("more cells than columns"))
    columns = []
    for name in wanted:
        if schema is None:
            columns.append(F.coalesce(F.col(name), F.lit("")).alias(name))
            continue
        field = schema[name]
        value = F.col(name) if isinstance(field.dataType, T.StringType) else F.expr(f"try_cast(trim(`{name}`) AS {field.dataType.simpleString()})")
        bad = (F.col(name).isNotNull() & value.isNull()) | (F.lit(not field.nullable) & F.col(name).isNull())
        kind = kind.when(bad, F.lit("Deserialization"))
        message = message.when(bad, F.lit(f"{name} does not decode as {field.dataType.simpleString()}"))
        columns.append(value.alias(name))
    return route(rows.select(*columns, "_seq", kind.alias(KIND), message.alias(MESSAGE)))


def read_tsv(spark: SparkSession, path: str, **options) -> Lanes:
    return read_csv(spark, path, sep="\t", **options)


def csv_rows(spark: SparkSession, path: str, **options) -> DataFrame:
    """The untyped form: one map of column name to cell per row, as event type csv.row."""
    data = read_csv(spark, path, **options).data
    names = [c for c in data.columns if not c.startswith("_")]
    cells = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))
    return data.select(F.lit("csv.row").alias("event_type"), cells.alias("row"), "_seq")
