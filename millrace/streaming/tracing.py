"""Spans of a run: name, seconds, error and attributes, to the log and to a callback (of a tracer, say)."""

from __future__ import annotations

import contextlib
import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

_log = logging.getLogger("millrace.trace")
OnSpan = Callable[[dict[str, Any]], None]


@contextlib.contextmanager
def span(name: str, on_span: OnSpan | None = None, **attributes: Any) -> Iterator[None]:
    """Times what happens inside; the span is given on the way out, also past an exception."""
    began, error = time.monotonic(), None
    try:
        yield
    except BaseException as exc:
        error = f"{type(exc).__name__}: {exc}"
        raise
    finally:
        made = {"name": name, "seconds": time.monotonic() - began, "error": error, **attributes}
        _log.log(logging.WARNING if error else logging.DEBUG, "%s took %.3f s%s", name, made["seconds"], f", {error}" if error else "", extra={"span": made})
        if on_span:
            on_span(made)


@dataclass(frozen=True)
class Spanned:
    """A sink whose writes are spans."""

    inner: Any
    on_span: OnSpan | None = None
    pipeline: str | None = None

    def write(self, df: DataFrame) -> None:
        with span("sink", self.on_span, sink=type(self.inner).__name__, pipeline=self.pipeline):
            self.inner.write(df)
