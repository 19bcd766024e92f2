"""Rate limiting, circuit breaking and retry, as pure state machines that also run as ordered folds."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import FatalError, HandlerError, Lanes, marked, route
from .operators.fold import ordered_fold
from .order import seconds


@dataclass
class TokenBucket:
    """Starts full, refills `rate` tokens a second up to `burst` (default: one second's worth)."""

    rate: float
    burst: float | None = None
    cost: float = 1.0
    tokens: float = field(init=False)
    at: float | None = None

    def __post_init__(self):
        if self.rate <= 0 or self.cost <= 0:
            raise ValueError("rate and cost must be positive")
        self.burst = max(self.rate, self.cost) if self.burst is None else self.burst
        if self.burst < self.cost:
            raise ValueError("the burst must hold one event")
        self.tokens = self.burst

    def admit(self, now: float) -> bool:
        if self.at is not None:
            self.tokens = min(self.burst, self.tokens + max(0.0, now - self.at) * self.rate)
        self.at = now if self.at is None else max(self.at, now)
        if self.tokens + 1e-9 < self.cost:
            return False
        self.tokens -= self.cost
        return True


def rate_limited(df: DataFrame, order: str, ts: str, rate: float, burst: float | None = None, cost: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """keys, order and admitted for each row, in order."""
    schema = T.StructType([*(df.schema[k] for k in keys), df.schema[order], T.StructField("admitted", T.BooleanType())])

    def step(bucket, row):
        return bucket, [{**{k: row[k] for k in keys}, order: row[order], "admitted": bucket.admit(row["_ts"])}]

    return ordered_fold(df.select(*{*keys, order}, seconds(df, ts).alias("_ts")), keys, order, lambda: TokenBucket(rate, burst, cost), step, schema)


@dataclass
class CircuitBreaker:
    """Opens after `failures` in a row, or where `window` is given, when of the last `window` calls (at least
    `minimum`) a share of `failure_rate` failed or `slow_rate` were slow. After open_for seconds it lets `probes` calls
    through: all well closes it, a failure opens it again."""

    failures: int = 5
    window: int | None = None
    minimum: int = 10
    failure_rate: float = 0.5
    slow_rate: float | None = None
    slow_seconds: float = 1.0
    open_for: float = 30.0
    probes: int = 1
    state: str = "closed"
    opened: float = 0.0
    _row: int = 0
    _calls: list = field(default_factory=list)
    _probing: int = 0
    _passed: int = 0

    def allows(self, now: float) -> bool:
        if self.state == "open" and now - self.opened >= self.open_for:
            self.state, self._probing, self._passed = "half_open", 0, 0
        if self.state == "half_open":
            if self._probing >= self.probes:
                return False
            self._probing += 1
            return True
        return self.state == "closed"

    def _open(self, now: float) -> None:
        self.state, self.opened, self._row, self._calls = "open", now, 0, []

    def record(self, ok: bool, now: float, seconds: float = 0.0) -> None:
        if self.state == "half_open":
            if not ok:
                self._open(now)
            else:
                self._passed += 1
                if self._passed >= self.probes:
                    self.state, self._row, self._calls = "closed", 0, []
            return
        if self.state == "open":
            return
        self._row = 0 if ok else self._row + 1
        if self.window is None:
            if self._row >= self.failures:
                self._open(now)
            return
        self._calls = [*self._calls, (ok, seconds >= self.slow_seconds)][-self.window :]
        n = len(self._calls)
        if n >= self.minimum and (sum(not o for o, _ in self._calls) / n >= self.failure_rate or (self.slow_rate is not None and sum(s for _, s in self._calls) / n >= self.slow_rate)):
            self._open(now)


def breaker_states(df: DataFrame, order: str, ts: str, ok: str, make: Callable[[], CircuitBreaker] = CircuitBreaker, keys: Sequence[str] = ()) -> DataFrame:
    """keys, order, allowed, state (after the call): a breaker over recorded call outcomes."""
    schema = T.StructType([*(df.schema[k] for k in keys), df.schema[order], T.StructField("allowed", T.BooleanType()), T.StructField("state", T.StringType())])

    def step(breaker, row):
        allowed = breaker.allows(row["_ts"])
        if allowed:
            breaker.record(bool(row[ok]), row["_ts"])
        return breaker, [{**{k: row[k] for k in keys}, order: row[order], "allowed": allowed, "state": breaker.state}]

    return ordered_fold(df.select(*{*keys, order, ok}, seconds(df, ts).alias("_ts")), keys, order, make, step, schema)


@dataclass(frozen=True)
class Retry:
    """Fixed or exponential waits between attempts, all of which start within `start_window` seconds."""

    attempts: int = 3
    initial: float = 0.25
    factor: float = 2.0
    cap: float = 4.0
    jitter: float = 0.1
    start_window: float = 120.0
    retryable: tuple[str, ...] = ("Timeout", "Remote", "RateLimited")

    def delay(self, attempt: int, rng: random.Random | None = None) -> float:
        base = min(self.cap, self.initial * self.factor**attempt)
        return base * (1 + self.jitter * ((rng or random).random() * 2 - 1))

    def call(self, function: Callable, *args, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        began = clock()
        for attempt in range(self.attempts):
            try:
                return function(*args)
            except Exception as error:
                wait = self.delay(attempt)
                last = attempt + 1 >= self.attempts or clock() - began + wait > self.start_window
                if last or getattr(error, "kind", "Remote") not in self.retryable:
                    raise
                sleep(wait)
        raise AssertionError("attempts must be positive")


def guarded(provider: Callable[[str], str], breaker: CircuitBreaker | None = None, retry: Retry | None = None, bucket: TokenBucket | None = None, clock: Callable[[], float] = time.monotonic) -> Callable[[str], str]:
    """A provider behind a limiter, a breaker and retries; refusals raise HandlerErrors of kind RateLimited or Remote.

    The limiter and breaker are this object's: one process has one of each. A stage that runs in many tasks takes guarded_stage.
    """

    def call(text: str) -> str:
        if bucket and not bucket.admit(clock()):
            raise HandlerError("rate limited", "RateLimited")
        if breaker and not breaker.allows(clock()):
            raise HandlerError("circuit open", "Remote")
        began = clock()
        try:
            out = retry.call(provider, text) if retry else provider(text)
        except Exception:
            if breaker:
                breaker.record(False, clock(), clock() - began)
            raise
        if breaker:
            breaker.record(True, clock(), clock() - began)
        return out

    return call


def guarded_stage(df: DataFrame, prompt: str, provider: Callable[[str], str], order: str, ts: str, bucket: Callable[[], TokenBucket] | None = None, breaker: Callable[[], CircuitBreaker] | None = None, retry: Retry | None = None, keys: Sequence[str] = (), reply: str = "reply") -> Lanes:
    """One effect per row behind one limiter and one breaker for the whole stage (or one of each per key), in the order of arrival.

    Calls are made one after another in that order and time is the rows' own (ts), so a run repeats exactly; refused calls are errors of kind RateLimited or
    Remote. That is sequential by definition: with keys, such as the host that is called, stages run in parallel.
    """
    base = marked(df)
    schema = T.StructType([*base.schema.fields, T.StructField(reply, T.StringType())])
    rows = base.withColumn("_guard_ts", seconds(df, ts))

    def initial():
        return (bucket() if bucket else None, breaker() if breaker else None)

    def step(state, row):
        limiter, switch = state
        now, out = row.pop("_guard_ts"), {reply: None}
        if row["_error_kind"] is None:
            try:
                if limiter and not limiter.admit(now):
                    raise HandlerError("rate limited", "RateLimited")
                if switch and not switch.allows(now):
                    raise HandlerError("circuit open", "Remote")
                try:
                    out[reply] = retry.call(provider, row[prompt]) if retry else provider(row[prompt])
                except Exception:
                    if switch:
                        switch.record(False, now)
                    raise
                if switch:
                    switch.record(True, now)
            except FatalError:
                raise
            except Exception as error:
                out |= {"_error_kind": getattr(error, "kind", "Remote"), "_error_message": str(error)}
        return state, [{**row, **out}]

    return route(ordered_fold(rows, keys, order, initial, step, schema))


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """df, and what is counted as its rows pass: no job of its own, read with observation.get once an action has run. By default rows and errors."""
    observation = Observation(name)
    rows = marked(df)
    counts = counts or {"rows": F.count(F.lit(1)), "errors": F.count("_error_kind")}
    return rows.observe(observation, *(c.alias(k) for k, c in counts.items())), observation


def notify(observers: Sequence[Callable[[str, dict], None]], event: str, facts: dict) -> None:
    """Tell read-only observers; one that raises is left alone and never fails the run."""
    for observer in observers:
        try:
            observer(event, dict(facts))
        except Exception:  # noqa: S110  an observer's fault is its own
            pass


#: What a signal gate decides: let the signal on, hold it for some seconds and ask again, or suppress it.
CONTINUE, SUPPRESS = "continue", "suppress"


@dataclass(frozen=True)
class Pause:
    seconds: float


@dataclass(frozen=True)
class SignalGate:
    """decide(signal, attempt) -> CONTINUE, SUPPRESS or a Pause. The default lets every signal on."""

    decide: Callable[[str, int], object] = lambda signal, attempt: CONTINUE

    def resolve(self, signal: str, sleep: Callable[[float], None] = time.sleep) -> bool:
        """Whether the signal goes on, after the pauses that the gate asks for."""
        attempt = 0
        while True:
            decision = self.decide(signal, attempt)
            if not isinstance(decision, Pause):
                if decision not in (CONTINUE, SUPPRESS):
                    raise ValueError(f"a gate says {CONTINUE}, {SUPPRESS} or a pause, not {decision!r}")
                return decision == CONTINUE
            sleep(decision.seconds)
            attempt += 1


def backoff_gate(delays: Sequence[float], signals: Sequence[str] = ("eof",)) -> SignalGate:
    """Hold these signals for each delay in turn, then let them on."""
    return SignalGate(lambda signal, attempt: Pause(delays[attempt]) if signal in signals and attempt < len(delays) else CONTINUE)


def composite_gate(*gates: SignalGate) -> SignalGate:
    """The strictest of the gates' decisions: suppression, then the longest pause, else on."""

    def decide(signal: str, attempt: int) -> object:
        decisions = [g.decide(signal, attempt) for g in gates]
        pauses = [d for d in decisions if isinstance(d, Pause)]
        return SUPPRESS if SUPPRESS in decisions else max(pauses, key=lambda p: p.seconds) if pauses else CONTINUE

    return SignalGate(decide)
