"""Options, with their defaults."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, fields

from .errors import BadRequest, TidemarkError


@dataclass(frozen=True)
class Options:
    freeze_rows: int = 1_000_000  #: the open batches are frozen at so many rows
    freeze_bytes: int = 256 << 20  #: or so many bytes
    max_frozen: int = 4  #: writes are refused at so many frozen groups
    max_new_runs: int = 20  #: or so many runs that are not sunk
    visibility_seconds: int = 600  #: after which written rows are sunk
    new_run_cap: int = 10  #: above it, maintenance compacts or sinks
    sinked_run_cap: int = 10  #: above it, maintenance compacts or evicts
    sink_bytes: int = 1 << 30
    compact_bytes: int = 1 << 30
    actions_per_pass: int = 64
    max_prefix_results: int = 10_000
    max_batch_rows: int = 1024  #: of rows given as Python objects
    hot_threshold: int = 3  #: reads of a base cell before it is kept in memory
    hot_bytes: int = 3 << 30
    cell_task_bytes: int = 256 << 20  #: a sink gives a cell a task for each so many bytes
    key_broadcast_bytes: int = 8 << 20  #: hot keys are broadcast up to this size (by manifest statistics)

    def __post_init__(self) -> None:
        for f in fields(self):
            if getattr(self, f.name) <= 0:
                raise BadRequest(f"option {f.name} must be positive")


def retried(call: Callable, retries: int = 3, first_ms: int = 10, most_ms: int = 640, sleep: Callable[[float], None] = time.sleep):
    """``call()``, again after 10, 20, ... ms where the error says that it may
    pass. Other errors, and outcomes that are unknown, are not tried again."""
    wait = first_ms
    for left in range(retries, -1, -1):
        try:
            return call()
        except TidemarkError as e:
            if not e.retryable or not left:
                raise
        sleep(wait / 1000)
        wait = min(wait * 2, most_ms)
