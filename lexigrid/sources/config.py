"""User configuration: a small JSON document on the driver, with known folders and recent projects."""

from __future__ import annotations

import json
import os

RECENT_PROJECTS = 10


class Config:
    def __init__(self, path: str):
        self.path = path

    def load(self) -> dict:
        """The document; {} if it is missing or can't be read."""
        try:
            with open(self.path, encoding="utf-8") as f:
                out = json.load(f)
        except (OSError, ValueError):
            return {}
        return out if isinstance(out, dict) else {}

    def save(self, doc: dict) -> None:
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(self.path, "w", encoding="utf-8") as f:
            json.dump(doc, f, indent=2, ensure_ascii=False)

    def touch_recent(self, folder: str) -> list[str]:
        """Move a project to the front; the last ten stay."""
        doc = self.load()
        doc["recent_projects"] = ([folder] + [p for p in doc.get("recent_projects", []) if p != folder])[:RECENT_PROJECTS]
        self.save(doc)
        return doc["recent_projects"]

    def folders(self) -> list[dict]:
        """Known folders that still exist, each with its favorite flag."""
        return [f for f in self.load().get("folders", []) if os.path.isdir(f["path"])]

    def _folders(self, change) -> None:
        doc = self.load()
        doc["folders"] = change(doc.get("folders", []))
        self.save(doc)

    def add_folder(self, path: str) -> None:
        self._folders(lambda fs: fs if any(f["path"] == path for f in fs) else [*fs, {"path": path, "favorite": False}])

    def remove_folder(self, path: str) -> None:
        self._folders(lambda fs: [f for f in fs if f["path"] != path])

    def toggle_folder(self, path: str) -> None:
        self._folders(lambda fs: [f | {"favorite": not f["favorite"]} if f["path"] == path else f for f in fs])
