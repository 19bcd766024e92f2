"""Run metrics as a table, and their text exposition."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import KIND, marked

SCHEMA = "stage string, metric string, labels map<string,string>, value double"


def stage_metrics(stage: str, df: DataFrame, processing: str | None = None) -> DataFrame:
    """Rows, errors by kind, and (from a column of seconds) the latency percentiles of a stage."""
    df = marked(df)
    counted = df.groupBy(KIND).agg(F.count(F.lit(1)).cast("double").alias("value"))
    events = counted.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value")).select(F.lit(stage).alias("stage"), F.lit("events_total").alias("metric"), F.create_map().cast("map<string,string>").alias("labels"), "value")
    errors = counted.filter(F.col(KIND).isNotNull()).select(F.lit(stage).alias("stage"), F.lit("errors_total").alias("metric"), F.create_map(F.lit("kind"), F.col(KIND)).alias("labels"), "value")
    out = events.unionByName(errors)
    if processing:
        quantiles = (0.5, 0.9, 0.95, 0.99, 0.999)
        found = df.agg(F.percentile_approx(processing, list(quantiles)).alias("q"))
        rows = found.select(F.posexplode("q").alias("i", "value")).select(
            F.lit(stage).alias("stage"), F.lit("processing_seconds").alias("metric"), F.create_map(F.lit("quantile"), F.element_at(F.array(*(F.lit(str(q)) for q in quantiles)), F.col("i") + 1)).alias("labels"), F.col("value").cast("double").alias("value")
        )
        out = out.unionByName(rows)
    return out


def run_metrics(run) -> DataFrame:
    """Metrics of a finished run of a flow, by stage: events in and out, errors by kind, how it ended, its seconds, rows delivered, and
    for the run its status and contracts. A row per stage, metric and label set; counts are one job over all stages."""
    spark, stages = run.spark, run.flow.stages
    parts, fixed = [], []
    for name, stage in stages.items():
        feeds = run.flow.inputs(name)
        fixed += [(name, "eof", {"kind": run.eof[name]}, 1.0), (name, "stage_seconds", {"kind": stage.kind}, run.seconds.get(name, 0.0)), (name, "inputs", {}, float(len(feeds)))]
        if name in run.outputs:
            kinds = marked(run.outputs[name]).select(F.lit(name).alias("stage"), F.lit("out").alias("lane"), F.col(KIND).alias("kind"))
            parts += [kinds, marked(run.errors[name]).select(F.lit(name).alias("stage"), F.lit("error").alias("lane"), F.col(KIND).alias("kind"))]
        elif isinstance(run.delivered.get(name), int):
            fixed.append((name, "delivered_total", {}, float(run.delivered[name])))
    fixed.append((run.flow.name, "run_status", {"status": run.manifest.status}, 1.0))
    if run.journal:
        fixed += [(v.edge, f"contract_{'passed' if v.passed else 'violated'}_total", {"contract": v.contract}, 1.0) for v in run.contracts()]
    counted: dict[tuple[str, str, str | None], int] = {}
    if parts:
        for r in reduce(DataFrame.unionByName, parts).groupBy("stage", "lane", "kind").count().collect():  # a row a stage, lane and kind
            counted[r["stage"], r["lane"], r["kind"]] = r["count"]
    for name in run.outputs:
        data = sum(n for (s, lane, _), n in counted.items() if s == name and lane == "out")
        fixed += [(name, "events_total", {}, float(data)), (name, "failures_total", {}, float(sum(n for (s, lane, _), n in counted.items() if s == name and lane == "error")))]
        fixed += [(name, "errors_total", {"kind": k, "lane": lane}, float(n)) for (s, lane, k), n in counted.items() if s == name and k is not None]
        feeds = run.flow.inputs(name)
        if feeds:
            fixed.append((name, "events_in_total", {}, float(sum(n for (s, lane, _), n in counted.items() if s in feeds and lane == "out"))))
    return spark.createDataFrame(fixed, SCHEMA)


def chunk_metrics(stage: str, chunks: DataFrame) -> DataFrame:
    """Of a table of chunks: chunks, items, estimated tokens, excluded items and rerendered chunks."""
    sums = chunks.agg(
        F.count("chunk_index").cast("double").alias("chunks_total"),
        F.coalesce(F.sum(F.size("item_ordinals")), F.lit(0)).cast("double").alias("chunk_items_total"),
        F.coalesce(F.sum("estimated_tokens"), F.lit(0)).cast("double").alias("chunk_tokens_total"),
        F.coalesce(F.sum(F.coalesce(F.json_array_length("excluded"), F.lit(0))), F.lit(0)).cast("double").alias("chunk_excluded_total"),
        F.count_if(F.col("depth") > 0).cast("double").alias("chunk_rerendered_total"),
    )
    names = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in sums.columns))
    return sums.select(F.explode(names).alias("m")).select(F.lit(stage).alias("stage"), "m.metric", F.create_map().cast("map<string,string>").alias("labels"), "m.value")


def limiter_metrics(stage: str, admissions: DataFrame) -> DataFrame:
    """Of rate_limited's result: admitted and refused calls."""
    counted = admissions.groupBy("admitted").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return counted.select(F.lit(stage).alias("stage"), F.when(F.col("admitted"), "limiter_admitted_total").otherwise("limiter_refused_total").alias("metric"), F.create_map().cast("map<string,string>").alias("labels"), "value")


def breaker_metrics(stage: str, states: DataFrame) -> DataFrame:
    """Of breaker_states' result: calls by the breaker's state and whether they were let through."""
    counted = states.groupBy("state", "allowed").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return counted.select(F.lit(stage).alias("stage"), F.lit("breaker_calls_total").alias("metric"), F.create_map(F.lit("state"), F.col("state"), F.lit("allowed"), F.col("allowed").cast("string")).alias("labels"), "value")


def anomalies(df: DataFrame, value: str, keys: tuple[str, ...] = (), deviations: float = 3.0) -> DataFrame:
    """Rows whose value lies more than so many standard deviations from its key's mean; the means are one row a key, joined back."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev(value).alias("_deviation"))
    joined = df.join(stats, list(keys)) if keys else df.crossJoin(F.broadcast(stats))  # one row
    return joined.filter(F.abs(F.col(value) - F.col("_mean")) > deviations * F.col("_deviation")).select(*df.columns)


def amendments(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, amendments: how many rows came for a key after its first."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("amendments"))


def rate(df: DataFrame, ts: str, seconds: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows a second in windows of the given length."""
    window = F.window(ts, f"{int(seconds * 1000)} milliseconds")
    return df.groupBy(*keys, window.alias("w")).agg((F.count(F.lit(1)) / F.lit(float(seconds))).alias("rate")).select(*keys, F.col("w.start").alias("start"), "rate")


def utilisation(busy: float, total: float) -> float:
    return min(1.0, busy / total) if total > 0 else 0.0


def saturation(queued: float, capacity: float) -> float:
    return queued / capacity if capacity > 0 else 0.0


def exposition(metrics: DataFrame, prefix: str = "flow_") -> str:
    """Text format of a metrics table. The table has a row per stage, metric and label set, not per event."""
    lines, seen = [], set()
    for r in sorted(metrics.collect(), key=lambda r: (r["metric"], r["stage"], sorted((r["labels"] or {}).items()))):
        name = prefix + r["metric"]
        if name not in seen:
            seen.add(name)
            lines.append(f"# TYPE {name} {'counter' if name.endswith('_total') else 'gauge'}")
        labels: Mapping[str, str] = {"stage": r["stage"], **(r["labels"] or {})}
        lines.append(f"{name}{{{','.join(f'{k}={chr(34)}{v}{chr(34)}' for k, v in sorted(labels.items()))}}} {r['value']:g}")
    return "\n".join(lines) + "\n"
