"""What a scan reports while it runs: handlers of its events, each a function of (event, **about)."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import functions as F


def nothing(event: str, **about) -> None:
    """The handler that says nothing; no job runs for it."""


def simple(out: TextIO, clock: Callable[[], float] = time.monotonic) -> Callable:
    """One line per event, with the seconds since the scan began."""
    began = clock()

    def handle(event: str, **about) -> None:
        shown = " ".join(f"{k}={v}" for k, v in about.items() if isinstance(v, str | int))
        print(f"[{clock() - began:6.1f} s] {event} {shown}".rstrip(), file=out)

    return handle


def tree(out: TextIO, clock: Callable[[], float] = time.monotonic) -> Callable:
    """The same, and the components that were found, by directory; they come to the driver, so it is for single systems."""
    plain = simple(out, clock)

    def handle(event: str, **about) -> None:
        plain(event, **about)
        if event == "components":
            for r in about["found"].orderBy("dir", "type", "name").select("dir", "type", "name").toLocalIterator():
                print(f"{'  ' * (r['dir'].count('/') if r['dir'] != '/' else 0)}{r['dir']}  {r['name']} ({r['type']})", file=out)

    return handle


def summary(out: TextIO, clock: Callable[[], float] = time.monotonic) -> Callable:
    """Counts of files and components once they are known, and the time in the end."""
    began = clock()

    def handle(event: str, **about) -> None:
        if event == "components":
            files = about["files"].agg(F.count("*").alias("n")).first()["n"]
            print(f"{files:,} files, {about['found'].count():,} components", file=out)
        elif event == "scan_complete":
            print(f"scan {about['root_id']} in {clock() - began:.1f} s", file=out)

    return handle


HANDLERS = {"none": lambda out: nothing, "simple": simple, "tree": tree, "summary": summary}
