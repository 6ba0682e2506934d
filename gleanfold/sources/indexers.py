"""The user's own indexers: versions of a small JSON file; a change is a new version, which only one writer can make.

A writer reads the newest version, makes its change, and links the result to the next number. The link fails if another
writer was quicker; then the change is made anew on what that one wrote. So no change is lost, and a reader never sees half of one.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Callable

#: Versions whose content stays besides the newest: readers may have one open.
KEPT = 8


class Indexers:
    """``path`` names the store: its versions are path.1, path.2, ... on a file system that its writers share. A file without number is version 0."""

    def __init__(self, path: str):
        self.path = path

    def _versions(self) -> list[int]:
        folder, name = os.path.split(os.path.abspath(self.path))
        try:
            found = os.listdir(folder)
        except FileNotFoundError:
            return []
        return sorted(int(m[1]) for f in found if (m := re.fullmatch(re.escape(name) + r"\.(\d+)", f)))

    def _read(self, version: int) -> list[dict]:
        try:
            with open(f"{self.path}.{version}" if version else self.path, encoding="utf-8") as f:
                rows = json.load(f)
        except (OSError, ValueError):
            return []
        return [r for r in rows if isinstance(r, dict) and r.get("id")] if isinstance(rows, list) else []

    def load(self) -> list[dict]:
        return self._read(max(self._versions(), default=0))

    def change(self, how: Callable[[list[dict]], list[dict] | None], tries: int = 1000) -> list[dict]:
        """Apply a change to the newest version; None leaves it. Tried again as often as other writers come first."""
        folder = os.path.dirname(os.path.abspath(self.path))
        os.makedirs(folder, exist_ok=True)
        for _ in range(tries):
            versions = self._versions()
            newest = max(versions, default=0)
            before = self._read(newest)
            rows = how(before)
            if rows is None:
                return before
            handle, part = tempfile.mkstemp(dir=folder, suffix=".tmp")
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                json.dump(rows, f, ensure_ascii=False, indent=1)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(part, f"{self.path}.{newest + 1}")
            except FileExistsError:
                continue
            finally:
                os.remove(part)
            for old in reversed(versions[:-KEPT]):  # emptied, not removed: a slow writer must find its number taken
                if not os.path.getsize(f"{self.path}.{old}"):
                    break
                os.truncate(f"{self.path}.{old}", 0)
            return rows
        raise RuntimeError(f"{self.path}: other writers came first {tries} times")

    def save(self, rows: list[dict]) -> None:
        """Replace all."""
        self.change(lambda _: rows)

    def add(self, name: str, url: str, api_key: str = "") -> dict:
        """Adds an indexer under an identifier made of its name; a taken one gets a number."""
        if not name.strip() or not re.match("https?://", url):
            raise ValueError("an indexer needs a name and an http address")
        base = "torznab:" + (re.sub("[^a-z0-9]+", "-", name.lower()).strip("-") or "indexer")
        row = {"id": base, "name": name.strip(), "url": url, "apiKey": api_key, "enabled": True}

        def with_row(rows: list[dict]) -> list[dict]:
            taken, new, n = {r["id"] for r in rows}, base, 2
            while new in taken:
                new, n = f"{base}-{n}", n + 1
            row["id"] = new
            return [*rows, row]

        self.change(with_row)
        return row

    def remove(self, indexer_id: str) -> bool:
        found = []

        def without(rows: list[dict]) -> list[dict] | None:
            kept = [r for r in rows if r["id"] != indexer_id]
            found[:] = [len(kept) < len(rows)]
            return kept if found[0] else None

        self.change(without)
        return found[0]

    def get(self, indexer_id: str) -> dict | None:
        return next((r for r in self.load() if r["id"] == indexer_id), None)

    def public(self) -> list[dict]:
        """For display: keys masked to their last four characters."""
        return [r | {"apiKey": "••••" + r["apiKey"][-4:] if r.get("apiKey") else ""} for r in self.load()]
