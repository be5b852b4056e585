"""Timed maintenance of an open store: flush, compaction and retention at the intervals of its settings."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

from tidestore.sources.store import SampleStore


class Timers:
    """``tick`` runs what is due; ``running`` ticks in a thread. A part that fails is counted, and the others still run."""

    def __init__(self, store: SampleStore) -> None:
        self.store = store
        config, began = store.config, store._now()
        parts: list[tuple[str, int, Callable[[], object]]] = [("sweep", config.sweep_us, store.sweep)]
        if config.compact_on:
            parts.append(("compact", config.compaction_us, store.compact))
        self._parts = parts
        self._due: dict[str, datetime] = {name: began + timedelta(microseconds=us) for name, us, _ in parts}

    def tick(self) -> list[str]:
        """Run the parts whose time has come; returns their names."""
        done = ["flush"] if self._run("flush", self.store.flush_due) else []
        for name, us, run in self._parts:
            if self.store._now() >= self._due[name]:
                self._run(name, run)
                self._due[name] = self.store._now() + timedelta(microseconds=us)
                self.store.counters[f"{name}s"] += 1
                done.append(name)
        return done

    def _run(self, name: str, run: Callable[[], object]) -> object:
        try:
            return run()
        except Exception as e:
            self.store.counters[f"{name}_failures"] += 1
            print(f"maintenance: {name}: {e}")
            return None

    @contextmanager
    def running(self, seconds: float = 1.0) -> Iterator[None]:
        """Tick every so many seconds until the block ends."""
        ended = threading.Event()

        def loop() -> None:
            while not ended.wait(seconds):
                self.tick()

        thread = threading.Thread(target=loop, daemon=True)
        thread.start()
        try:
            yield
        finally:
            ended.set()
            thread.join()
