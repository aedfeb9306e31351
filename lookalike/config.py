"""Settings: the environment before the file before the defaults."""

from __future__ import annotations

import json
import os
from pathlib import Path

from .schema import CACHE_DAYS, DEFAULT_THRESHOLD, HISTORY_LENGTH, INDEX_LEAST

DEFAULTS = {
    "threshold": DEFAULT_THRESHOLD,
    "index_from": INDEX_LEAST,
    "cache_days": CACHE_DAYS,
    "history_length": HISTORY_LENGTH,
    "cache": "~/.lookalike/cache",
    "session": "~/.lookalike/session.json",
    "history": "~/.lookalike/history.json",
    "trash": "~/.lookalike/trash",
}


class Config:
    def __init__(self, file: str | None = None, env: dict[str, str] | None = None) -> None:
        self.file = Path(file or "~/.lookalike/config.json").expanduser()
        self.env = os.environ if env is None else env
        self._read: dict | None = None

    def migrate(self, legacy: str | Path) -> bool:
        """Take over an older settings file, if there is one and none of our own yet."""
        old = Path(legacy).expanduser()
        if self.file.exists() or not old.is_file():
            return False
        self.file.parent.mkdir(parents=True, exist_ok=True)
        draft = self.file.with_name(f"{self.file.name}.part-{os.getpid()}")
        draft.write_bytes(old.read_bytes())
        os.replace(draft, self.file)
        self.reload()
        return True

    def reload(self) -> None:
        self._read = None

    def _from_file(self) -> dict:
        if self._read is None:
            try:
                found = json.loads(self.file.read_text())
                self._read = found if isinstance(found, dict) else {}
            except (OSError, ValueError):
                self._read = {}
        return self._read

    def get(self, key: str, default=None):
        """LOOKALIKE_<KEY>, read as JSON where it is that; then the file; then the default."""
        text = self.env.get(f"LOOKALIKE_{key.upper()}")
        if text is not None:
            try:
                return json.loads(text)
            except ValueError:
                return text
        return self._from_file().get(key, DEFAULTS.get(key) if default is None else default)

    def path(self, key: str) -> Path:
        return Path(str(self.get(key))).expanduser()

    def write_example(self) -> Path:
        self.file.parent.mkdir(parents=True, exist_ok=True)
        if not self.file.exists():
            self.file.write_text(json.dumps(DEFAULTS, indent=2))
        return self.file
