"""The time loop: ordered steps over a state, with stop rules, output periods, checkpoints and going back."""

from __future__ import annotations

import time as clock
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.graph import _cut
from ..sources.sinks import Checkpoints

State = dict[str, DataFrame]
WHERE = ("build", "init", "start_init", "continue_init", "compute", "restore", "mesh_changed", "exit")


@dataclass
class TimeLoop:
    """Entry points by ``where``; each takes (loop, state) and returns the new state."""

    state: State
    dt: float = 1.0
    final_time: float = float("inf")
    max_iterations: int = 1_000_000
    cut_every: int = 4
    time: float = 0.0
    iteration: int = 0
    stop_reason: str | None = None
    steps: dict[str, list[tuple[str, Callable]]] = field(default_factory=dict)
    observers: list[Callable] = field(default_factory=list)
    timings: dict[str, float] = field(default_factory=dict)
    kept: dict[int, tuple[float, State]] = field(default_factory=dict)
    keep_every: int = 0
    keep_most: int = 3

    def add(self, where: str, name: str, step: Callable) -> TimeLoop:
        if where not in WHERE:
            raise ValueError(f"{where} is none of {WHERE}")
        self.steps.setdefault(where, []).append((name, step))
        return self

    def _run(self, where: str) -> None:
        for name, step in self.steps.get(where, []):
            began = clock.monotonic()
            for o in self.observers:
                o("begin", name, self)
            self.state = step(self, self.state) or self.state
            for o in self.observers:
                o("end", name, self)
            self.timings[name] = self.timings.get(name, 0.0) + clock.monotonic() - began

    def start(self, restored: bool = False) -> None:
        self._run("build")
        self._run("init")
        self._run("continue_init" if restored else "start_init")

    def one_iteration(self) -> bool:
        """False once the loop is to stop."""
        if self.stop_reason:
            return False
        if self.keep_every and self.iteration % self.keep_every == 0:
            self.kept[self.iteration] = (self.time, {k: _cut(f) for k, f in self.state.items()})
            for old in sorted(self.kept)[: -self.keep_most]:
                del self.kept[old]
        self.iteration += 1
        self.time += self.dt
        try:
            self._run("compute")
        except Exception:
            self.stop_reason = "error"
            raise
        if self.cut_every and self.iteration % self.cut_every == 0:
            self.state = {k: _cut(f) for k, f in self.state.items()}
        if self.time >= self.final_time:
            self.stop_reason = "final time"
        elif self.iteration >= self.max_iterations:
            self.stop_reason = "maximum of iterations"
        return self.stop_reason is None

    def run(self, most: int | None = None) -> str | None:
        """Iterate until a stop rule holds, or ``most`` iterations are done."""
        n = 0
        while (most is None or n < most) and self.one_iteration():
            n += 1
        if self.stop_reason:
            self._run("exit")
        return self.stop_reason

    def stop(self, reason: str = "asked for") -> None:
        self.stop_reason = reason

    def go_back(self, iterations: int) -> int:
        """Restore the last kept version at least so many iterations ago; returns its iteration."""
        wanted = [n for n in self.kept if n <= self.iteration - iterations]
        if not wanted:
            raise ValueError(f"nothing kept that is {iterations} iterations old")
        self.iteration = max(wanted)
        self.time, self.state = self.kept[self.iteration]
        self._run("restore")
        return self.iteration

    def checkpoint(self, store: Checkpoints) -> None:
        store.write(self.iteration, self.state, time=self.time, dt=self.dt)

    def restart(self, store: Checkpoints, number: int | None = None) -> None:
        self.state, info = store.read(number)
        self.iteration, self.time, self.dt = info["number"], info["time"], info["dt"]
        self.start(restored=True)


def every(period: int, step: Callable) -> Callable:
    """A step that acts only each ``period`` iterations."""
    return lambda loop, state: step(loop, state) if loop.iteration % period == 0 else state


def every_time(period: float, step: Callable) -> Callable:
    """A step that acts when simulated time enters a new period."""

    def run(loop: TimeLoop, state: State):
        return step(loop, state) if int(loop.time / period) != int((loop.time - loop.dt) / period) else state

    return run


def balance(period: int, limit: float, cost: Callable, move: Callable, least: float = 0.0) -> Callable:
    """Rebalance each ``period`` iterations if (max - min) / min of the parts' costs reaches the limit and the dearest part costs at least ``least``."""

    def run(loop: TimeLoop, state: State):
        costs = cost(loop, state)
        low, high = min(costs), max(costs)
        if high < least or (low > 0 and (high - low) / low < limit):
            return state
        return move(loop, state)

    return every(period, run)
