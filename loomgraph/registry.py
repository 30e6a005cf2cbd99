"""DataFrame-to-DataFrame steps by task and name, and chains of them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

Step = Callable[..., DataFrame]
_steps: dict[tuple[str, str], Step] = {}


def register(task: str, name: str) -> Callable[[Step], Step]:
    def add(fn: Step) -> Step:
        _steps[task, name] = fn
        return fn

    return add


def get(task: str, name: str) -> Step:
    return _steps[task, name]


def names(task: str) -> list[str]:
    return sorted(n for t, n in _steps if t == task)


def delays(attempts: int, first: float, policy: str = "exponential", most: float = 60.0) -> list[float]:
    """Seconds to wait before each attempt but the first: ``fixed``, ``linear`` or ``exponential`` from ``first`` on, at most ``most``."""
    grow = {"fixed": lambda k: 1, "linear": lambda k: k + 1, "exponential": lambda k: 2**k}[policy]
    return [min(most, first * grow(k)) for k in range(attempts - 1)]


def retrying(action: Callable[[], object], attempts: int = 3, first: float = 1.0, policy: str = "exponential", fatal: tuple = (ValueError, TypeError), sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of a driver-side action, such as a write, tried again after errors that aren't ``fatal``. Spark retries lost tasks itself."""
    for wait in delays(attempts, first, policy):
        try:
            return action()
        except fatal:
            raise
        except Exception:
            sleep(wait)
    return action()


class Pipeline:
    """Named steps with dependencies; each gets the frames of the steps it names. Lazy until an action on the result."""

    def __init__(self):
        self.steps: dict[str, tuple[Step, tuple[str, ...]]] = {}

    def add(self, name: str, fn: Step, *needs: str) -> Pipeline:
        if name in self.steps:
            raise ValueError(f"step {name} is there already")
        self.steps[name] = (fn, needs)
        return self

    def order(self) -> list[str]:
        done: list[str] = []
        open_: list[str] = []

        def visit(name: str) -> None:
            if name in done or name not in self.steps:
                return
            if name in open_:
                raise ValueError(f"cycle at {name}")
            open_.append(name)
            for n in self.steps[name][1]:
                visit(n)
            open_.remove(name)
            done.append(name)

        for name in self.steps:
            visit(name)
        return done

    def run(self, **inputs: DataFrame) -> dict[str, DataFrame]:
        frames = dict(inputs)
        for name in self.order():
            fn, needs = self.steps[name]
            if missing := [n for n in needs if n not in frames]:
                raise ValueError(f"{name} needs {missing}")
            frames[name] = fn(*(frames[n] for n in needs))
        return frames
