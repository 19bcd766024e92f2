"""Flows: named stages wired by a checked topology, lowered to one DataFrame graph.

    flow = Flow("sla")
    tickets = flow.source("tickets", read_tickets, Ticket)
    flow.transform("urgent", filter_rows_of(...)) ...
    flow.edges("tickets |> urgent |> out", "(customers, urgent) |> enriched")

Stages are functions of DataFrames; Catalyst optimises across them. With a journal each stage is written and
read back, which ends its lineage; without one the whole flow is a single plan per sink.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..contracts import Verdict, transport
from ..errors import Lanes, marked, route
from ..journal.runs import Journal, Manifest, open_archive, worst_eof
from ..middleware import notify
from ..operators.cycle import MAX_ITERATIONS, iterate
from ..operators.join import Joined
from ..order import canonical_fan_in
from ..schema import EventType, check_schema
from ..sinks.callback import redelivery_gate
from ..streaming.resume import resume_source


class FlowError(ValueError):
    """The flow cannot be built: its declarations contradict each other."""


@dataclass
class Stage:
    name: str
    kind: str
    run: Callable | None
    takes: list[EventType] = field(default_factory=list)
    gives: list[EventType] = field(default_factory=list)
    order: str | Sequence[str] | None = None
    sink: object = None
    effectful: bool = False
    options: dict = field(default_factory=dict)


#: Stages whose result depends on the order of their input; above them a fan-in is merged canonically.
ORDERED = ("stateful", "join", "effect")


class Flow:
    def __init__(self, name: str, config: dict | None = None):
        if not re.fullmatch(r"[A-Za-z][\w-]*", name):
            raise FlowError(f"not a flow name: {name!r}")
        self.name, self.stages, self.links, self.back, self.config = name, {}, [], [], dict(config or {})

    def _add(self, stage: Stage) -> str:
        if stage.name in self.stages:
            raise FlowError(f"two stages are called {stage.name}")
        if not re.fullmatch(r"[A-Za-z][\w-]*", stage.name):
            raise FlowError(f"not a stage name: {stage.name!r}")
        self.stages[stage.name] = stage
        return stage.name

    @staticmethod
    def _types(given) -> list[EventType]:
        return [] if given is None else [given] if isinstance(given, EventType) else list(given)

    def source(self, name: str, read: Callable[[SparkSession], DataFrame | Lanes], gives=None, order=None, completion: Callable[[Lanes], str] | None = None) -> str:
        """completion: how the source ends, natural or poison, judged from its lanes (by default natural)."""
        return self._add(Stage(name, "source", read, [], self._types(gives), order, options={"completion": completion}))

    def transform(self, name: str, run: Callable[[DataFrame], DataFrame | Lanes], takes=None, gives=None, order=None, effectful: bool = False) -> str:
        return self._add(Stage(name, "effect" if effectful else "transform", run, self._types(takes), self._types(gives), order, effectful=effectful))

    def stateful(self, name: str, run: Callable[[DataFrame], DataFrame], takes=None, gives=None, order=None) -> str:
        return self._add(Stage(name, "stateful", run, self._types(takes), self._types(gives), order))

    def effect(self, name: str, run: Callable[[DataFrame], DataFrame | Lanes], takes=None, gives=None, facts=(), order=None) -> str:
        """An effectful stage. facts: the event types its effects may give, all among `gives`, each once."""
        stage = Stage(name, "effect", run, self._types(takes), self._types(gives), order, effectful=True, options={"facts": self._types(facts)})
        given, named = {t.versioned for t in stage.gives}, [t.versioned for t in stage.options["facts"]]
        if len(named) != len(set(named)):
            raise FlowError(f"{name} declares a fact twice")
        if not set(named) <= given:
            raise FlowError(f"{name} does not give its facts {sorted(set(named) - given)}")
        return self._add(stage)

    def join(self, name: str, run: Callable[[DataFrame, DataFrame], DataFrame | Joined], takes=None, gives=None, order=None) -> str:
        """run(reference, stream). Its edge is written (reference, stream) |> name."""
        return self._add(Stage(name, "join", run, self._types(takes), self._types(gives), order))

    def sink(self, name: str, sink: object, takes=None, order: str | None = None) -> str:
        return self._add(Stage(name, "sink", None, self._types(takes), [], order, sink))

    def placeholder(self, name: str, takes=None, gives=None) -> str:
        """A stage of a skeleton: it type-checks, and fails when run."""

        def missing(*_):
            raise NotImplementedError(f"stage {name} is a placeholder")

        return self._add(Stage(name, "transform", missing, self._types(takes), self._types(gives)))

    def loop(self, name: str, step: Callable[[DataFrame], DataFrame], done, takes=None, gives=None, max_iterations: int = MAX_ITERATIONS) -> str:
        """A backflow cycle with one entry point, as a stage."""
        self._add(Stage(name, "loop", lambda df: iterate(df, step, done, max_iterations), self._types(takes), self._types(gives)))
        self.back.append((name, name))
        return name

    def composite(self, prefix: str, build: Callable[[Flow, str], tuple[str, str]]) -> tuple[str, str]:
        """A reusable subgraph: build(flow, prefix) adds stages and edges and returns its (entry, exit) ports."""
        ports = build(self, prefix)
        if any(p not in self.stages for p in ports):
            raise FlowError(f"composite {prefix} returns ports that are no stages")
        return ports

    def edges(self, *lines: str) -> Flow:
        """'a |> b |> c', or '(reference, stream) |> join'."""
        for line in lines:
            parts = [p.strip() for p in line.split("|>")]
            if len(parts) < 2:
                raise FlowError(f"no edge in {line!r}")
            for a, b in zip(parts, parts[1:], strict=False):
                pair = re.fullmatch(r"\((.+),(.+)\)", a)
                if pair:
                    self.links += [(pair[1].strip(), b, "reference"), (pair[2].strip(), b, "stream")]
                else:
                    self.links.append((a, b, "input"))
        return self

    # --- analysis -----------------------------------------------------------------------------------

    def inputs(self, name: str, role: str | None = None) -> list[str]:
        return [a for a, b, r in self.links if b == name and (role is None or r == role)]

    def topological(self) -> list[str]:
        left, out = dict.fromkeys(self.stages), []
        while left:
            ready = [n for n in left if all(i not in left for i in self.inputs(n))]
            if not ready:
                raise FlowError(f"a cycle outside a loop stage: {sorted(left)}")
            out += ready
            for n in ready:
                del left[n]
        return out

    def validate(self) -> list[str]:
        """Check names, arity, types and containment; returns the stages in order."""
        for a, b, _ in self.links:
            for n in (a, b):
                if n not in self.stages:
                    raise FlowError(f"an edge names {n}, which is no stage")
            if self.stages[a].kind == "sink" or self.stages[b].kind == "source":
                raise FlowError(f"{a} |> {b} leaves a sink or enters a source")
        for name, stage in self.stages.items():
            refs, streams, plain = (self.inputs(name, r) for r in ("reference", "stream", "input"))
            if stage.kind == "join" and (len(refs) != 1 or not streams or plain):
                raise FlowError(f"join {name} needs (reference, stream)")
            if stage.kind != "join" and (refs or streams):
                raise FlowError(f"{name} is no join")
            if stage.kind not in ("source", "join") and not plain:
                raise FlowError(f"{name} has no input")
            names = [t.name for t in stage.gives]
            if len(names) != len(set(names)):
                raise FlowError(f"{name} gives a type twice")
            if stage.takes:
                for up in {*plain, *streams, *refs}:
                    given = {t.versioned for t in self.stages[up].gives}
                    if given and not given & {t.versioned for t in stage.takes}:
                        raise FlowError(f"{up} |> {name}: {sorted(given)} is not taken")
        return self.topological()

    def topology(self) -> str:
        """The flow as JSON: stages and edges."""
        stages = [{"name": s.name, "kind": s.kind, "takes": [t.versioned for t in s.takes], "gives": [t.versioned for t in s.gives]} for s in self.stages.values()]
        edges = [{"from": a, "to": b, "role": r} for a, b, r in self.links] + [{"from": a, "to": b, "role": "backflow"} for a, b in self.back]
        return json.dumps({"flow": self.name, "stages": stages, "edges": edges}, indent=1)

    # --- execution ----------------------------------------------------------------------------------

    def _merged(self, outputs: dict[str, DataFrame], names: list[str], stage: Stage) -> DataFrame:
        parts = {}
        for n in names:
            df = outputs[n]
            if stage.takes and "event_type" in df.columns:  # a subscriber sees its types only
                test = None
                for t in stage.takes:
                    test = t.matches(df["event_type"]) if test is None else test | t.matches(df["event_type"])
                df = df.filter(test)
            parts[n] = df
        if len(parts) == 1:
            return next(iter(parts.values()))
        if stage.kind in ORDERED and stage.order:
            return canonical_fan_in(parts, stage.order)
        first, *rest = parts.values()
        for df in rest:
            first = first.unionByName(df, allowMissingColumns=True)
        return first

    def _checked(self, stage: Stage, df: DataFrame) -> None:
        if len(stage.gives) == 1 and stage.kind != "sink":
            check_schema(df, stage.gives[0].schema, f"stage {stage.name}")

    def run(
        self,
        spark: SparkSession,
        journal: str | Journal | None = None,
        replay_from: str | None = None,
        allow_incomplete: bool = False,
        repeat_sinks: set[str] = frozenset(),
        resume_from: str | None = None,
        observers: Sequence[Callable[[str, dict], None]] = (),
    ) -> Run:
        """Run the flow. journal: a new directory for this run, or a journal. replay_from: an archived run whose sources are read instead.

        resume_from: an archived run, complete or not, to go on from: each source gives its archived rows, and then the rows of its own beyond the last of them.
        observers are told of stages and of the run's end; they cannot change or fail it.
        """
        order = self.validate()
        archive, eof = None, "natural"
        if resume_from and (replay_from or self.back):
            raise FlowError("a resumed run is no replay" if replay_from else "a flow with cycles cannot be resumed")
        if replay_from:
            redelivery_gate({n: s.sink for n, s in self.stages.items() if s.kind == "sink"}, repeat_sinks)
            archive, manifest, eof = open_archive(spark, replay_from, allow_incomplete)
            if manifest.flow != self.name:
                raise FlowError(f"{replay_from} is a run of {manifest.flow}")
        log = journal if isinstance(journal, Journal) else Journal(spark, journal) if journal else None
        record = Manifest(self.name, uuid.uuid4().hex, config=self.config, replay_of=replay_from, cyclic=bool(self.back))
        record.sinks = {n: getattr(s.sink, "redelivery", "undeclared") for n, s in self.stages.items() if s.kind == "sink"}
        if log:
            log.save(record)
        run = Run(self, record, log, spark)
        try:
            for name in order:
                notify(observers, "stage_started", {"stage": name, "kind": self.stages[name].kind})
                began = time.monotonic()
                self._step(spark, run, name, archive, eof, resume_from)
                run.seconds[name] = time.monotonic() - began
                notify(observers, "stage_completed", {"stage": name, "eof": run.eof[name], "seconds": run.seconds[name]})
        except BaseException as error:
            record.status = "failed"
            if log:
                log.save(record)
            notify(observers, "run_failed", {"flow": self.name, "error": str(error)})
            raise
        record.status = "completed"
        if log:
            log.save(record)
        notify(observers, "run_completed", {"flow": self.name, "run": record.run})
        return run

    def _step(self, spark: SparkSession, run: Run, name: str, archive: Journal | None, eof: str, resume_from: str | None = None) -> None:
        stage = self.stages[name]
        feeds = self.inputs(name)
        state = worst_eof(*(run.eof[i] for i in feeds)) if feeds else eof
        if stage.kind == "source":
            out = archive.read(name).drop("_pos") if archive else stage.run(spark)
            judge = stage.options.get("completion")
            if judge and not archive:
                state = worst_eof(state, judge(out if isinstance(out, Lanes) else Lanes(out, marked(out).limit(0))))
            if resume_from:
                if not isinstance(stage.order, str):
                    raise FlowError(f"source {name} needs one order column to be resumed")
                live = out if isinstance(out, Lanes) else Lanes(out, None)
                data = resume_source(spark, resume_from, name, marked(live.data), stage.order)
                out = data.drop("_generation") if live.errors is None else Lanes(data.drop("_generation"), live.errors)
        elif stage.kind == "join":
            out = stage.run(self._merged(run.outputs, self.inputs(name, "reference"), stage), self._merged(run.outputs, self.inputs(name, "stream"), stage))
            if isinstance(out, Joined):
                if out.misses is not None:
                    state = worst_eof(state, out.status)
                out = out.rows
        elif stage.kind == "sink":
            df = self._merged(run.outputs, feeds, stage)
            run.delivered[name] = stage.sink.write(df, stage.order) if stage.sink is not None else None
            run.eof[name] = state
            run.manifest.stages[name] = {"kind": stage.kind, "eof": state}
            return
        else:
            out = stage.run(self._merged(run.outputs, feeds, stage))
        lanes = out if isinstance(out, Lanes) else route(out) if "_error_kind" in out.columns else Lanes(out, marked(out).limit(0))
        self._checked(stage, lanes.data)
        run.errors[name] = lanes.errors
        run.outputs[name] = run.journal.write(name, lanes, stage.order) if run.journal else lanes.data
        run.eof[name] = state
        run.manifest.stages[name] = {"kind": stage.kind, "eof": state}


@dataclass
class Run:
    """A finished run: outputs and error lanes by stage, EOF kinds, and what sinks returned."""

    flow: Flow
    manifest: Manifest
    journal: Journal | None
    spark: SparkSession
    outputs: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, DataFrame] = field(default_factory=dict)
    eof: dict[str, str] = field(default_factory=dict)
    delivered: dict[str, object] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    def contracts(self) -> list[Verdict]:
        """Transport contract of every edge: rows in the journal against rows a reader of the edge sees."""
        if not self.journal:
            raise ValueError("contracts are checked on a journal")
        return [transport(f"{a} |> {b}", self.journal.read(a), self.outputs[a]) for a, b, _ in self.flow.links if self.flow.stages[a].kind != "sink"]


def declared(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)
