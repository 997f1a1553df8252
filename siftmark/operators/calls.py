"""Calls of a backend from inside a task: several in flight, a time limit for each, repeats, and a rate that all tasks share."""

from __future__ import annotations

import math
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator


class Refused(Exception):
    """The backend won't answer this for safety."""


class Exhausted(Exception):
    """The backend won't answer anything any more, as when a budget is spent: nothing more is asked."""


class Unanswered(RuntimeError):
    """No call got an answer."""


class Slots:
    """Moments at which a task may call: time is cut into slots of ``length`` seconds, and task k of n owns each n-th one.

    As slots are cut by the clock, calls of all tasks together keep at least a slot's distance on average and no two share
    one, whenever tasks start or are started again. Clocks of executors need to agree within a slot.
    """

    def __init__(self, length: float, task: int, tasks: int, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.length, self.task, self.tasks, self.clock, self.sleep = length, task % tasks, tasks, clock, sleep
        self.last, self.lock = -1, threading.Lock()

    def wait(self) -> int:
        """Sleeps until the next own slot, which is taken; its number."""
        with self.lock:
            k = max(self.last + 1, math.ceil(self.clock() / self.length))
            k += (self.task - k) % self.tasks
            self.last = k
        while (rest := k * self.length - self.clock()) > 0:
            self.sleep(rest)
        return k


def retried(answer: Callable, tries: int, delay_s: float = 0.0, slots: Slots | None = None) -> Callable:
    """``answer`` called up to ``tries`` times, with linear delays; refusals aren't asked again, and an exhausted backend nothing more."""
    gone: list[Exhausted] = []

    def call(texts: list[str]) -> list[str]:
        for attempt in range(tries):
            if gone:
                raise gone[0]
            if slots:
                slots.wait()
            try:
                return answer(texts)
            except Refused:
                raise
            except Exhausted as e:
                gone.append(e)
                raise
            except Exception:  # noqa: BLE001  any failure of a call is worth another one
                if attempt + 1 == tries:
                    raise Unanswered(f"no answer after {tries} calls") from None
                time.sleep(delay_s * (attempt + 1))
        raise Unanswered("no call was allowed")

    return call


class _Call:
    """A call in a thread of its own. What is still out after its time is left to itself; its answer isn't used."""

    def __init__(self, call: Callable, item, limit: float | None, over: threading.Condition):
        self.outcome, self.until, self.over = None, math.inf if limit is None else time.monotonic() + limit, over
        threading.Thread(target=self.run, args=(call, item), daemon=True).start()

    def run(self, call: Callable, item) -> None:
        outcome = _outcome(call, item)
        with self.over:
            self.outcome = outcome
            self.over.notify_all()

    def live(self) -> bool:
        if self.outcome is None and time.monotonic() >= self.until:
            self.outcome = TimeoutError("the call took too long")
        return self.outcome is None


def _outcome(call: Callable, item):
    try:
        return call(item)
    except Exception as e:  # noqa: BLE001  an outcome, for the caller to read
        return e


def fan_out(call: Callable, items: Iterable, at_once: int = 1, limit_s: float | None = None) -> Iterator:
    """What ``call`` gives for each item, or its exception, in the items' order.

    At most ``at_once`` calls are out at a time; one over its limit counts as a TimeoutError and its place is free. Once a
    call ends with Exhausted, the items not yet asked get the same without a call. Results wait for earlier ones in a window
    of eight times ``at_once``.
    """
    gone = None
    if at_once == 1 and limit_s is None:
        for item in items:
            out = gone or _outcome(call, item)
            gone = out if isinstance(out, Exhausted) else gone
            yield out
        return
    over, window, out = threading.Condition(), deque(), []

    def wait(until: Callable[[], bool]) -> None:
        with over:
            while not until():
                first = min((c.until for c in out if c.outcome is None), default=math.inf)
                over.wait(None if first == math.inf else max(0.0, first - time.monotonic()))

    def free() -> bool:
        out[:] = [c for c in out if c.live()]
        return len(out) < at_once

    for item in items:
        wait(free)
        gone = gone or next((c.outcome for c in window if isinstance(c.outcome, Exhausted)), None)
        if gone:
            done = _Done(gone)
            window.append(done)
        else:
            c = _Call(call, item, limit_s, over)
            out.append(c)
            window.append(c)
        while window and (not window[0].live() or len(window) >= 8 * at_once):
            wait(lambda: not window[0].live())
            first = window.popleft().outcome
            gone = gone or (first if isinstance(first, Exhausted) else None)
            yield first
    while window:
        wait(lambda: not window[0].live())
        yield window.popleft().outcome


class _Done:
    def __init__(self, outcome):
        self.outcome, self.until = outcome, math.inf

    def live(self) -> bool:
        return False
