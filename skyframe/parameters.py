"""Settings of a user's work: folders of data and other values, with defaults, kept in a file if asked to."""

from __future__ import annotations

import json
from collections.abc import Iterator, MutableMapping
from pathlib import Path

#: Settings that are always there.
DEFAULTS = {"data_dirs": [], "clean_level": "clean", "directory_format": "{platform}/{name}/{tag}/{inst_id}", "ignore_empty_files": False, "update_files": True, "warn_empty_file_list": False}


class Parameters(MutableMapping):
    """A mapping of names to values that JSON can hold. Settings with a default can be changed but not taken away; others are free.

    With ``path`` (on the driver's machine) they are read from there, if the file is there, and :meth:`store` writes them back.
    """

    def __init__(self, path: str | None = None):
        self.path = None if path is None else Path(path)
        self._held = json.loads(self.path.read_text()) if self.path is not None and self.path.exists() else {}

    def __getitem__(self, name: str):
        if name in self._held:
            return self._held[name]
        if name in DEFAULTS:
            value = DEFAULTS[name]
            return list(value) if isinstance(value, list) else value
        raise KeyError(name)

    def __setitem__(self, name: str, value) -> None:
        if name == "data_dirs":
            value = [value] if isinstance(value, str) else list(value)
        if name in DEFAULTS and not isinstance(value, type(DEFAULTS[name])):
            raise ValueError(f"{name} is a {type(DEFAULTS[name]).__name__}, not {value!r}")
        json.dumps(value)
        self._held[name] = value

    def __delitem__(self, name: str) -> None:
        if name not in self._held and name in DEFAULTS:
            raise KeyError(f"{name} has its default")
        del self._held[name]

    def __iter__(self) -> Iterator[str]:
        return iter(dict.fromkeys([*DEFAULTS, *self._held]))

    def __len__(self) -> int:
        return len({*DEFAULTS, *self._held})

    def restore_defaults(self) -> None:
        """Settings with a default get it back, but for the folders of data; free ones stay."""
        self._held = {k: v for k, v in self._held.items() if k not in DEFAULTS or k == "data_dirs"}

    def clear(self) -> None:
        """Nothing but defaults."""
        self._held = {}

    def store(self) -> None:
        if self.path is None:
            raise ValueError("there is no file to store to")
        self.path.parent.mkdir(parents=True, exist_ok=True)
        new = self.path.with_name(self.path.name + ".new")
        new.write_text(json.dumps(self._held, indent=1, sort_keys=True))
        new.replace(self.path)

    def folders(self, platform: str, name: str, tag: str = "", inst_id: str = "") -> tuple[str, ...]:
        """Where an instrument's files may lie, by the format of folders under each folder of data; parts without a name drop out."""
        inner = "/".join(p for p in self["directory_format"].format(platform=platform, name=name, tag=tag, inst_id=inst_id).split("/") if p)
        return tuple(f"{d.rstrip('/')}/{inner}" for d in self["data_dirs"])
