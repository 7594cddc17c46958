"""Progress lines on a terminal or a log: a stage, a count, and a status."""

from __future__ import annotations

import sys
import time
from typing import TextIO

#: A plain log gets a line every so many items or seconds.
ITEMS, SECONDS, WIDTH = 100, 0.25, 20


def bar(current: int, total: int) -> str:
    if total <= 0:
        return "[....]"
    filled = min(WIDTH, max(0, current) * WIDTH // total)
    return "[" + "#" * filled + "." * (WIDTH - filled) + "]"


class Reporter:
    """``mode``: tty (one line, drawn again), plain (log lines), quiet, or auto, which is tty on a terminal."""

    def __init__(self, mode: str = "auto", out: TextIO | None = None, clock=time.monotonic):
        self.out, self.clock = out or sys.stderr, clock
        mode = mode.strip().lower() or "auto"
        self.mode = mode if mode in ("tty", "plain", "quiet") else "tty" if self.out.isatty() else "plain"
        self.stage, self.total, self.current, self.status = "", 0, 0, ""
        self.width, self.at, self.shown = 0, None, 0

    def start(self, stage: str, total: int = 0, status: str = "") -> None:
        self.stage, self.total, self.current, self.status, self.at = stage, total, 0, status.strip(), None
        self.draw(force=True)

    def advance(self, n: int = 1, status: str = "") -> None:
        self.current += n
        self.status = status.strip() or self.status
        self.draw()

    def finish(self, status: str = "") -> None:
        self.status = status.strip() or self.status
        if self.mode == "tty":
            self.out.write("\r" + self.line().ljust(self.width) + "\n")
        elif self.mode == "plain":
            self.out.write(self.line() + "\n")
        self.stage, self.total, self.current, self.status, self.width, self.shown = "", 0, 0, "", 0, 0

    def line(self) -> str:
        if self.mode == "tty":
            return f"{bar(self.current, self.total)} {self.stage} {self.current}{f'/{self.total}' if self.total > 0 else ''} {self.status}"
        return f"stage={self.stage} current={self.current}{f' total={self.total}' if self.total > 0 else ''} status={self.status}"

    def draw(self, force: bool = False) -> None:
        if not self.stage or self.mode == "quiet":
            return
        if self.mode == "tty":
            line = self.line()
            self.out.write("\r" + line.ljust(self.width))
            self.width = max(self.width, len(line))
            return
        now = self.clock()
        if force or self.at is None or self.current - self.shown >= ITEMS or now - self.at >= SECONDS:
            self.out.write(self.line() + "\n")
            self.at, self.shown = now, self.current
