"""Append-only records of named things, versioned by content, as JSON lines; and a run tracker."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import time
from typing import Any


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def fingerprint(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


class Registry:
    """A file of records, one a line, that only grows.

    Writers take turns by a lock on the file and look at all of it, so one content has one version whoever adds it.
    """

    def __init__(self, path: str):
        self.path = path

    @staticmethod
    def _indexed(lines) -> dict[tuple[str, str], dict[str, dict]]:
        """{(kind, name): {fingerprint: record}}, oldest first."""
        index: dict[tuple[str, str], dict[str, dict]] = {}
        for record in map(json.loads, filter(str.strip, lines)):
            index.setdefault((record["kind"], record["name"]), {})[record["fingerprint"]] = record
        return index

    def _index(self) -> dict[tuple[str, str], dict[str, dict]]:
        if not os.path.exists(self.path):
            return {}
        with open(self.path) as f:
            fcntl.flock(f, fcntl.LOCK_SH)
            return self._indexed(f)

    def versions(self, kind: str, name: str) -> list[dict]:
        """All records of a name, oldest first."""
        return [*self._index().get((kind, name), {}).values()]

    def register(self, kind: str, name: str, payload: Any) -> dict:
        """The record of this content, new or known; new content of a name is its next version."""
        mark = fingerprint(payload)
        with open(self.path, "a+") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.seek(0)
            own = self._indexed(f).get((kind, name), {})
            if mark not in own:
                own[mark] = {"kind": kind, "name": name, "version": len(own) + 1, "fingerprint": mark, "payload": payload}
                f.write(canonical(own[mark]) + "\n")  # a file opened to append writes at its end
            return own[mark]

    def get(self, kind: str, name: str, version: int | None = None) -> dict:
        """A version of a name; the last one without a number."""
        own = self.versions(kind, name)
        at = len(own) if version is None else version
        if not 1 <= at <= len(own):
            raise KeyError((kind, name, version))
        return own[at - 1]


def reference(record: dict) -> dict:
    return {k: record[k] for k in ("kind", "name", "version", "fingerprint")}


def versioned_name(record: dict) -> str:
    return f"{record['name']}_v{record['version']}"


class NullTracker:
    def log(self, step: int, **metrics: float) -> None: ...

    def close(self) -> None: ...


class JsonTracker(NullTracker):
    """Metrics as JSON lines."""

    def __init__(self, path: str):
        self.file = open(path, "a")  # noqa: SIM115

    def log(self, step: int, **metrics: float) -> None:
        self.file.write(canonical({"step": step, "time": time.time(), **metrics}) + "\n")

    def close(self) -> None:
        self.file.close()


def write_json(path: str, value: Any) -> None:
    """Whole or not at all."""
    with open(f"{path}.tmp", "w") as f:
        json.dump(value, f, indent=1, sort_keys=True, default=str)
    os.replace(f"{path}.tmp", path)


def read_json(path: str) -> Any:
    with open(path) as f:
        return json.load(f)
