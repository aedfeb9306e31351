"""Checks of requests before any work is done. Each returns None or says what is wrong."""

from __future__ import annotations

import os
from datetime import datetime
from pathlib import Path

from .schema import DATED_STEPS, PIPELINE_STEPS


def within(path: str, root: str) -> bool:
    """Whether a path, links resolved, is root or below it."""
    p, r = Path(path).resolve(), Path(root).resolve()
    return p == r or r in p.parents


def readable_file(path: str) -> str | None:
    if not os.path.exists(path):
        return f"{path} does not exist"
    if not os.path.isfile(path):
        return f"{path} is no file"
    return None if os.access(path, os.R_OK) else f"{path} can't be read"


def directory(path: str) -> str | None:
    if not path:
        return "no directory is given"
    if not os.path.isdir(path):
        return f"{path} is no directory"
    return None if os.access(path, os.R_OK | os.X_OK) else f"{path} can't be read"


def threshold(value) -> str | None:
    if isinstance(value, bool) or not isinstance(value, int):
        return "the threshold must be a whole number"
    return None if 0 <= value <= 64 else "the threshold must be from 0 to 64"


def workers(value) -> str | None:
    if isinstance(value, bool) or not isinstance(value, int):
        return "workers must be a whole number"
    return None if 1 <= value <= 32 else "workers must be from 1 to 32"


def clamped(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def scan(path: str, threshold_: int = 10, exact_only: bool = False, perceptual_only: bool = False) -> list[str]:
    found = [directory(path), threshold(threshold_)]
    if exact_only and perceptual_only:
        found.append("exact only and perceptual only exclude each other")
    return [x for x in found if x]


def pipeline(steps: list[str], start: datetime | None, end: datetime | None) -> list[str]:
    unknown = [s for s in steps if s not in PIPELINE_STEPS]
    found = [f"unknown step {s}" for s in unknown]
    if not steps:
        found.append("no steps")
    if set(steps) & set(DATED_STEPS):
        if start is None or end is None:
            found.append("these steps need a start and an end date")
        elif start >= end:
            found.append("start must lie before end")
    return found
