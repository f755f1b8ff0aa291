"""Settings with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """window: instances a bounded model remembers. tries, depth, sort_window: the hash forest. start_budget, budget_step: search.
    executions: sequences that a start executes in a round of search, or no limit. solves, progresses: where suggesting stops. kill_after_s: how long a benchmark
    outlives its limit. nesting: searches inside searches. record: whether executions are recorded."""

    window: int = 1000
    tries: int = 11
    depth: int = 9
    sort_window: int = 1000
    start_budget: int = 8
    budget_step: int = 1
    executions: int | None = None
    solves: int = 10
    progresses: int = 10000
    nesting: int = 2
    kill_after_s: float = 5.0
    record: bool = True
    struct_weight: float = 1.0
