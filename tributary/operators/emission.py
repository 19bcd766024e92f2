"""When an accumulator emits.

OnEof: only at the end. EmitAlways: after every row. EveryN(n): once n rows have come since the last
emission. TimeWindow(seconds): a period opens at its first row and closes with the first row that is `seconds` or more after it, which
belongs to it; then the state resets. All but a reset TimeWindow emit the final state once more at the end.
"""

from __future__ import annotations

from dataclasses import dataclass


class Emission:
    """Custom policies override should_emit(rows since the last emission, seconds since the period's first row)."""

    resets = False

    def should_emit(self, rows: int, elapsed: float) -> bool:
        raise NotImplementedError

    def emit_interval_hint(self) -> float | None:
        """Seconds after which a stage should ask again though no row has come; None where time alone never emits."""
        return None


@dataclass(frozen=True)
class OnEof(Emission):
    def should_emit(self, rows: int, elapsed: float) -> bool:
        return False


@dataclass(frozen=True)
class EmitAlways(Emission):
    def should_emit(self, rows: int, elapsed: float) -> bool:
        return True


@dataclass(frozen=True)
class EveryN(Emission):
    n: int

    def __post_init__(self):
        if self.n <= 0:
            raise ValueError("EveryN needs n > 0")

    def should_emit(self, rows: int, elapsed: float) -> bool:
        return rows >= self.n


@dataclass(frozen=True)
class TimeWindow(Emission):
    seconds: float
    resets = True

    def __post_init__(self):
        if self.seconds <= 0:
            raise ValueError("TimeWindow needs a positive duration")

    def should_emit(self, rows: int, elapsed: float) -> bool:
        return elapsed >= self.seconds

    def emit_interval_hint(self) -> float | None:
        return self.seconds


@dataclass(frozen=True)
class EmitInterval(Emission):
    """A stage's emit interval: what `policy` says, and a snapshot with the first row `seconds` or more after the first one since the last emission."""

    seconds: float
    policy: Emission = OnEof()

    def __post_init__(self):
        if self.seconds <= 0:
            raise ValueError("an emit interval is positive")

    @property
    def resets(self) -> bool:
        return self.policy.resets

    def should_emit(self, rows: int, elapsed: float) -> bool:
        return elapsed >= self.seconds or self.policy.should_emit(rows, elapsed)

    def emit_interval_hint(self) -> float | None:
        inner = self.policy.emit_interval_hint()
        return self.seconds if inner is None else min(self.seconds, inner)
