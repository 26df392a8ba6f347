"""Progress events around stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from tessera.vocabulary import STAGES


@dataclass(frozen=True)
class Event:
    stage: str
    phase: str


@contextmanager
def reported(stage: str, listener: Callable[[Event], None] | None) -> Iterator[None]:
    if stage not in STAGES:
        raise ValueError(stage)
    if listener:
        listener(Event(stage, "start"))
    yield
    if listener:
        listener(Event(stage, "done"))
