"""Options of a pipeline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from millrace.operators.resilience import RetryPolicy


@dataclass(frozen=True)
class PipelineOptions:
    """How a pipeline runs. All of them are read when it runs, whenever they were set.

    parallelism: partitions of shuffles; capacity: rows per Arrow batch; both hold while a run lasts. attempt_timeout_s
    (0: none) and retry go for functions on rows that have none of their own. retry_table: where a stream's transient
    failures wait. meter: gets counters and a histogram (streaming.meters). on_span gets a dict per step of a run: name, seconds, error.
    """

    parallelism: int | None = None
    capacity: int = 1000
    continue_on_error: bool = True
    total_timeout_s: float = 300.0
    attempt_timeout_s: float = 30.0
    dedup_keys: tuple[str, ...] = ()
    dedup_watermark: tuple[str, str] | None = None
    dead_letter: Any = None
    retry: RetryPolicy = field(default_factory=RetryPolicy)
    retry_table: str | None = None
    on_span: Callable[[dict], None] | None = None
    on_metrics: Callable[[dict], None] | None = None
    meter: Any = None
    on_state: Callable[[str, str], None] | None = None
    compact: bool = False

    def __post_init__(self) -> None:
        if self.capacity < 1 or (self.parallelism is not None and self.parallelism < 1):
            raise ValueError("parallelism and capacity must be positive")
