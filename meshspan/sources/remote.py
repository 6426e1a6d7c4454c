"""Adapters for services and tools outside: each takes the call that reaches out as an argument.

Nothing here opens a connection; a deployment passes its own ``fetch``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator


class ServerError(Exception):
    """A page that the server could not make."""


def pages(fetch: Callable[[int, int, str], list[dict]], where: str = "", size: int = 2000, smallest: int = 100, tries: int = 4, start: int = 0, pause_s: float = 0.15) -> Iterator[list[dict]]:
    """Feature pages ``fetch(offset, size, where)`` until a short or empty one.

    A failing page is asked for again at half the size, ``smallest`` at least,
    ``tries`` times in all.  ``start`` resumes after features already written.
    """
    at = start
    while True:
        for k in range(tries):
            try:
                got = fetch(at, size, where)
                break
            except ServerError:
                if k + 1 == tries:
                    raise
                size = max(smallest, size // 2)
        if got:
            yield got
            at += len(got)
        if len(got) < size:
            return
        time.sleep(pause_s)


def bbox_where(west: float, south: float, east: float, north: float) -> str:
    """The envelope filter that a feature server evaluates itself."""
    return json.dumps({"xmin": west, "ymin": south, "xmax": east, "ymax": north, "spatialReference": {"wkid": 4326}})


def fetch_tile(fetch: Callable[[str], bytes], write: Callable[[str, bytes], None], name: str, tries: int = 5, most_s: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> None:
    """One elevation tile with doubling waits between tries; ``write`` renames a finished file into place."""
    for k in range(tries):
        try:
            data = fetch(name)
        except OSError:
            if k + 1 == tries:
                raise
            sleep(min(most_s, 2.0**k))
        else:
            write(name, data)
            return


class TileQueue:
    """Wanted tiles by priority: a name once, raised if asked for more urgently; low requests are shed when full."""

    def __init__(self, cap: int = 256, shed_below: int = 10):
        self.cap, self.shed_below = cap, shed_below
        self.waiting: dict[str, tuple[int, int]] = {}
        self.flying: dict[str, int] = {}
        self._n = 0

    def submit(self, name: str, priority: int) -> bool:
        if name in self.flying:
            self.flying[name] = max(self.flying[name], priority)
            return True
        if name not in self.waiting and len(self.waiting) >= self.cap and priority < self.shed_below:
            return False
        self._n += 1
        old = self.waiting.get(name)
        self.waiting[name] = (max(priority, old[0]), old[1]) if old else (priority, self._n)
        return True

    def take(self) -> str | None:
        if not self.waiting:
            return None
        name = min(self.waiting, key=lambda x: (-self.waiting[x][0], self.waiting[x][1]))
        self.flying[name] = self.waiting.pop(name)[0]
        return name

    def done(self, name: str) -> None:
        self.flying.pop(name, None)


def run_source(run: Callable[[str], list[dict]], config: dict, known: dict[str, str], key: str) -> tuple[list[dict] | None, str]:
    """Features of a source plugin, or None if its settings' fingerprint is the known one."""
    import hashlib

    text = json.dumps(config, sort_keys=True, separators=(",", ":"))
    print_ = hashlib.sha256(text.encode()).hexdigest()
    return (None, print_) if known.get(key) == print_ else (run(text), print_)
