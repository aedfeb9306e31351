"""What a session knows on the driver: progress, settings, selections, and the directories that were used last."""

from __future__ import annotations

import json
import os
import threading
import time
from dataclasses import asdict, dataclass, field
from pathlib import Path

from .schema import HISTORY_LENGTH, SESSION_HOURS


def _replace(path: Path, value) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_name(f"{path.name}.part-{os.getpid()}")
    draft.write_text(json.dumps(value, indent=1))
    os.replace(draft, path)


@dataclass
class Session:
    """status: idle, scanning, analyzing, comparing, complete, cancelled or error."""

    status: str = "idle"
    message: str = ""
    progress: int = 0
    directory: str = ""
    settings: dict = field(default_factory=lambda: {"threshold": 10, "exact_only": False, "perceptual_only": False, "recursive": True, "strategy": "quality"})
    details: dict = field(default_factory=lambda: {"processed": 0, "total": 0, "rate": 0.0, "eta_seconds": 0.0})
    selections: dict[str, str] = field(default_factory=dict)
    errors: list[dict] = field(default_factory=list)
    saved_at: float = 0.0

    def __post_init__(self) -> None:
        self._lock, self._cancel, self._pause = threading.Lock(), False, False

    def reset(self) -> None:
        self.__dict__.update(Session().__dict__)

    @property
    def cancel_requested(self) -> bool:
        with self._lock:
            return self._cancel

    def cancel(self) -> None:
        with self._lock:
            self._cancel = True

    @property
    def paused(self) -> bool:
        with self._lock:
            return self._pause

    def pause(self, on: bool = True) -> None:
        with self._lock:
            self._pause = on

    def advance(self, done: int, total: int, started: float, now: float | None = None) -> None:
        """Percent, rate and time left; nothing to do is all done."""
        passed = max(1e-9, (time.time() if now is None else now) - started)
        rate = done / passed
        self.progress = 100 if total == 0 else int(100 * done / total)
        self.details = {"processed": done, "total": total, "rate": rate, "eta_seconds": (total - done) / rate if rate else 0.0}

    def status_view(self) -> dict:
        return {k: getattr(self, k) for k in ("status", "message", "progress", "directory", "settings", "details")}

    def save(self, file: str | Path, now: float | None = None) -> None:
        self.saved_at = time.time() if now is None else now
        value = asdict(self)
        if self.status != "complete":
            value["selections"] = {}
        _replace(Path(file), value)

    @classmethod
    def load(cls, file: str | Path, now: float | None = None) -> Session | None:
        """None if there is no session, or one older than a day."""
        try:
            value = json.loads(Path(file).read_text())
        except (OSError, ValueError):
            return None
        if (time.time() if now is None else now) - value.get("saved_at", 0) > SESSION_HOURS * 3600:
            return None
        fresh = cls()
        for k in asdict(fresh):
            if k in value:
                setattr(fresh, k, {**getattr(fresh, k), **value[k]} if k in ("settings", "details") else value[k])
        return fresh


class History:
    """Directories, the last used first."""

    def __init__(self, file: str | Path, most: int = HISTORY_LENGTH) -> None:
        self.file, self.most = Path(file), most

    def load(self) -> list[str]:
        try:
            found = json.loads(self.file.read_text())
        except (OSError, ValueError):
            return []
        return [x for x in found if isinstance(x, str)] if isinstance(found, list) else []

    def add(self, directory: str) -> list[str]:
        found = [directory, *(x for x in self.load() if x != directory)][: self.most]
        _replace(self.file, found)
        return found

    def search(self, text: str) -> list[str]:
        return [x for x in self.load() if text.lower() in x.lower()]
