"""A row-by-row writer that gathers changes and writes them in batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from tidemark.config import retried
from tidemark.operators.table import Table


class BufferedWriter:
    """Changes go to the table when there are ``max_rows`` of them or ``max_bytes``
    (as they print), when the oldest has waited ``interval`` seconds (0: each row at
    once), and at ``flush``, which a checkpoint calls. Order is kept; a batch that is
    refused because the table is busy is tried again, and stays if that fails."""

    def __init__(self, table: Table, max_rows: int = 256, max_bytes: int = 4 << 20, interval: float = 0.05, clock: Callable[[], float] = time.monotonic):
        self.table, self.max_rows, self.max_bytes, self.interval, self.clock = table, min(max_rows, table.options.max_batch_rows), max_bytes, interval, clock
        self.held: list[tuple[str, dict]] = []
        self.bytes, self.since = 0, 0.0

    def add(self, kind: str, row: Mapping) -> None:
        if not self.held:
            self.since = self.clock()
        self.held.append((kind, dict(row)))
        self.bytes += sum(len(str(v)) for v in row.values())
        if self.due():
            self.flush()

    def due(self) -> bool:
        """Has a limit been reached? Call it now and then when no rows come."""
        waited = self.clock() - self.since >= self.interval
        return bool(self.held) and (len(self.held) >= self.max_rows or self.bytes >= self.max_bytes or self.interval == 0 or waited)

    def flush(self) -> int | None:
        """Write what is held; the last sequence."""
        if not self.held:
            return None
        with self.table.metrics.timed("flush"):
            last = retried(lambda: self.table.write_batch(self.held), retries=10)
        self.table.metrics.add("rows_flushed", len(self.held))
        self.held, self.bytes = [], 0
        return last

    def __enter__(self) -> BufferedWriter:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is None:
            self.flush()
