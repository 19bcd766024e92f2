"""Verification of one run against another, stage by stage and place by place."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import Journal, open_archive

#: Divergences kept per stage; counting goes on beyond.
KEPT = 5
CERTIFIED, DIVERGED, UNCERTIFIED, REFUSED = 0, 1, 2, 3


@dataclass
class Report:
    exit_code: int
    stages: dict[str, dict] = field(default_factory=dict)
    reason: str = ""

    @property
    def verdict(self) -> str:
        return ("certified", "diverged", "uncertified", "refused")[self.exit_code]


def _projected(df: DataFrame) -> DataFrame:
    """Place and what is compared: type, payload, status and error; no ids, times, deliveries or observations."""
    payload = sorted(c for c in df.columns if not c.startswith("_") and c != "event_type")
    kind = F.col("event_type") if "event_type" in df.columns else F.lit(None).cast("string")
    error = [F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("_error_kind", "_error_message")]
    shown = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}) if payload else F.lit("{}")
    return df.select("_pos", F.struct(kind.alias("event_type"), shown.alias("payload"), error[0].alias("kind"), error[1].alias("message")).alias("row"))


def compare(baseline: DataFrame, candidate: DataFrame, prefix: bool = False) -> DataFrame:
    """Places that differ: _pos, baseline, candidate. prefix: what the candidate has beyond the baseline's end is no difference."""
    a, b = _projected(baseline).withColumnRenamed("row", "baseline"), _projected(candidate).withColumnRenamed("row", "candidate")
    joined = a.join(b, "_pos", "left" if prefix else "full")
    return joined.filter(~F.col("baseline").eqNullSafe(F.col("candidate")))


def verify(spark: SparkSession, baseline: str, candidate: str, prefix: bool = False, stages: list[str] | None = None) -> Report:
    """0 certified, 1 diverged, 2 some stages could not be compared, 3 refused (an archive that cannot be used)."""
    try:
        (old, a, _), (new, b, _) = open_archive(spark, baseline), open_archive(spark, candidate)
    except ValueError as error:
        return Report(REFUSED, reason=str(error))
    if a.flow != b.flow:
        return Report(REFUSED, reason=f"runs of {a.flow} and {b.flow}")
    report, code = Report(CERTIFIED), CERTIFIED
    kinds = {**a.stages, **b.stages}
    for stage in stages or sorted(s for s in kinds if kinds[s].get("kind") != "sink"):  # sinks have deliveries only
        if not (old.has(stage) and new.has(stage)):
            report.stages[stage] = {"status": "missing"}
            code = max(code, UNCERTIFIED) if code != DIVERGED else code
            continue
        found = {}
        for lane in (False, True):
            if old.has(stage, lane) != new.has(stage, lane):
                found["errors_lane"] = 1
            if not (old.has(stage, lane) and new.has(stage, lane)):
                continue
            if lane:  # the error lane has no order of its own: compared as a multiset
                diff = _multiset(old.read(stage, True), new.read(stage, True))
            else:
                diff = compare(old.read(stage), new.read(stage), prefix)
            found["errors" if lane else "data"] = diff.count()
            if not lane and found["data"]:
                found["first"] = [r.asDict(True) for r in diff.orderBy("_pos").limit(KEPT).collect()]
        same = not any(v for k, v in found.items() if k != "first")
        report.stages[stage] = {"status": "same" if same else "diverged", **found}
        code = code if same else DIVERGED
        if a.stages.get(stage, {}).get("eof") != b.stages.get(stage, {}).get("eof") and not prefix:
            report.stages[stage]["status"], code = "diverged", DIVERGED
    report.exit_code = code
    return report


def _multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    rows = lambda df: df.select(F.to_json(F.struct(*sorted(c for c in df.columns if not c.startswith("_") or c.startswith("_error"))), {"ignoreNullFields": "false"}).alias("row"))
    return rows(a).exceptAll(rows(b)).union(rows(b).exceptAll(rows(a)))


def journal_counts(journal: Journal, stages: list[str]) -> dict[str, int]:
    return {s: journal.read(s).count() for s in stages}
