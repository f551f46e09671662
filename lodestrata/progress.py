"""Progress of long commands and the tokens that models used; silent unless a line writer is given."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Task:
    """A step of known or unknown size."""

    name: str
    total: int | None = None
    done: int = 0
    ended: float | None = None


@dataclass
class Progress:
    """Steps in order of their start; ``write`` gets a line at every change."""

    write: Callable[[str], None] | None = None
    tasks: list[Task] = field(default_factory=list)
    tokens: dict[str, int] = field(default_factory=lambda: {"input": 0, "output": 0})
    estimated: bool = False

    def _say(self, t: Task) -> None:
        if self.write:
            share = f"{t.done}/{t.total}" if t.total is not None else str(t.done)
            self.write(f"{t.name}: {share}{' done' if t.ended is not None else ''}")

    def start(self, name: str, total: int | None = None) -> Task:
        self.tasks.append(Task(name, total))
        self._say(self.tasks[-1])
        return self.tasks[-1]

    def add(self, task: Task, n: int = 1) -> None:
        task.done += n
        self._say(task)

    def stop(self, task: Task) -> None:
        task.ended = time.time()
        self._say(task)

    def use(self, given: int, made: int, estimated: bool) -> None:
        """Count tokens of a model's call; one estimate makes the sums estimates."""
        self.tokens["input"] += given
        self.tokens["output"] += made
        self.estimated |= estimated
        if self.write:
            self.write(f"tokens: {sum(self.tokens.values())}{' (estimated)' if self.estimated else ''}")
