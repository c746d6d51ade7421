"""The list of projects, a small file on the driver."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

NAME = re.compile(r"^[a-z][a-z0-9_-]{0,63}$")
VERSION = 1


class Registry:
    """Projects by name, each with an absolute root. The file is replaced as a whole, so readers never see half of it."""

    def __init__(self, file: str | Path):
        self.file = Path(file)

    def entries(self) -> dict[str, dict[str, str]]:
        if not self.file.exists():
            return {}
        data = json.loads(self.file.read_text())
        if not isinstance(data, dict) or data.get("version") != VERSION or not isinstance(data.get("projects"), dict):
            raise ValueError(f"{self.file} is no registry of version {VERSION}")
        for name, entry in data["projects"].items():
            if not NAME.match(name) or not os.path.isabs(str(entry.get("root", ""))):
                raise ValueError(f"{name} is no valid entry")
        return data["projects"]

    def add(self, name: str, root: str, description: str = "") -> None:
        entries = self.entries()
        root = os.path.realpath(root)
        if not NAME.match(name):
            raise ValueError("a name is a small letter and up to 63 of a-z, 0-9, _ and -")
        if name in entries or root in (e["root"] for e in entries.values()):
            raise ValueError("that name or root is registered")
        if not os.path.isdir(root):
            raise ValueError("the root is no folder")
        self._write(entries | {name: {"root": root, "description": description}})

    def remove(self, name: str) -> None:
        entries = self.entries()
        del entries[name]
        self._write(entries)

    def _write(self, entries: dict) -> None:
        new = self.file.with_suffix(f".{os.getpid()}.new")
        with new.open("w") as out:
            json.dump({"version": VERSION, "projects": entries}, out, indent=1, sort_keys=True)
            out.flush()
            os.fsync(out.fileno())
        os.replace(new, self.file)
