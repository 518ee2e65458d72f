"""Column metadata: a small table of variables and labels that travels in the schema of a DataFrame."""

from __future__ import annotations

import copy
import csv
import math
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The standard labels, and what a label means when nothing is said.
LABELS = ("units", "long_name", "notes", "desc", "value_min", "value_max", "fill")
NUMERIC_LABELS = ("value_min", "value_max", "fill")
KEY, HEADER = "labels", "header"
EPOCH_LABELS, EPOCH_TEXT = ("units", "long_name", "desc", "notes"), "Milliseconds since 1970-1-1 00:00:00"


def default_fill(kind: T.DataType | None):
    """NaN for floating, -1 for whole numbers, '' for text, else None."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return math.nan
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return -1
    return "" if isinstance(kind, T.StringType) else None


def _default(variable: str, label: str, kind: T.DataType | None = None):
    if label == "long_name":
        return variable
    if label == "scale":
        return "linear"
    if label == "fill":
        return default_fill(kind)
    return math.nan if label in NUMERIC_LABELS else ""


def _same(a, b) -> bool:
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


class Meta:
    """``{variable: {label: value}}`` with a header of free attributes; names are found whatever their case."""

    def __init__(self, variables: Mapping[str, Mapping] | None = None, header: Mapping | None = None):
        self._table: dict[str, dict] = {}
        self.header = dict(header or {})
        for name, labels in (variables or {}).items():
            self[name] = labels

    @classmethod
    def of(cls, df: DataFrame) -> Meta:
        """What the schema holds, with defaults by type."""
        out = cls()
        for f in df.schema:
            held = {k: math.nan if v == "NaN" and k in NUMERIC_LABELS else v for k, v in f.metadata.get(KEY, {}).items()}
            out._table[f.name] = {k: _default(f.name, k, f.dataType) for k in LABELS} | held
            out.header |= f.metadata.get(HEADER, {})
        return out

    def attach(self, df: DataFrame) -> DataFrame:
        """``df`` with these labels in its schema; they survive selects, aliases and Parquet, not expressions."""
        for f in df.schema:
            if (name := self.name_of(f.name)) in self._table:
                labels = {k: "NaN" if isinstance(v, float) and math.isnan(v) else v for k, v in self._table[name].items() if v is not None}
                df = df.withMetadata(f.name, dict(f.metadata) | {KEY: labels} | ({HEADER: self.header} if self.header else {}))
        return df

    def relabel(self, names: Mapping[str, str]) -> None:
        """Renames labels of all variables, and brings in those that no variable has yet, by their defaults; a name that is taken is a ValueError."""
        for old, new in names.items():
            old = self.label_of(old)
            if old != new and new in self.labels:
                raise ValueError(f"there is a label {new} already")
            for variable, row in self._table.items():
                row[new] = row.pop(old) if old in row else _default(variable, new)

    def accept_labels(self, other: Meta) -> None:
        """Both get all labels of either, by their defaults where they were not known; labels that differ in case take the other's."""
        for label in other.labels:
            if (held := self.label_of(label)) != label and held in self.labels:
                self.relabel({held: label})
        for a, b in ((self, other), (other, self)):
            for variable, row in a._table.items():
                for label in b.labels:
                    row.setdefault(label, _default(variable, label))

    def to_header(self, attributes: Mapping[str, object], *, strict: bool = False) -> None:
        """Adds free attributes to the header; with ``strict`` one that is there already is an AttributeError, and nothing is added."""
        if strict and (both := sorted(attributes.keys() & self.header.keys())):
            raise AttributeError(f"in the header already: {both}")
        self.header |= attributes

    def add_epoch(self, name: str = "epoch") -> None:
        """Says what the time index is in those of its labels that are empty."""
        held = self[name] if name in self else {}
        said = {k: EPOCH_TEXT for k in EPOCH_LABELS if k not in held or held[k] in ("", None) or (k == "long_name" and held[k] == self.name_of(name))}
        self[name] = said

    def name_of(self, name: str) -> str:
        """The name as it is held, found without regard to case."""
        return next((k for k in self._table if k.lower() == name.lower()), name)

    def label_of(self, label: str) -> str:
        return next((k for k in self.labels if k.lower() == label.lower()), label)

    @property
    def labels(self) -> list[str]:
        return list(dict.fromkeys([*LABELS, *(k for v in self._table.values() for k in v)]))

    def __setitem__(self, key, value) -> None:
        if isinstance(key, tuple):
            self[key[0]] = {key[1]: value}
            return
        name = self.name_of(key)
        held = self._table.setdefault(name, {k: _default(name, k) for k in LABELS})
        held |= {self.label_of(k): v for k, v in value.items()}
        for other, row in self._table.items():
            for label in held:
                row.setdefault(label, _default(other, label))

    def __getitem__(self, key):
        name, label = key if isinstance(key, tuple) else (key, None)
        if label is None and name in self.header:
            return self.header[name]
        row = self._table[self.name_of(name)]
        return dict(row) if label is None else row[self.label_of(label)]

    def __contains__(self, name: str) -> bool:
        return self.name_of(name) in self._table

    def __delitem__(self, name: str) -> None:
        self.drop(name)

    def __eq__(self, other) -> bool:
        if not isinstance(other, Meta) or self._table.keys() != other._table.keys() or self.header != other.header:
            return False
        return all(a.keys() == other._table[k].keys() and all(_same(v, other._table[k][n]) for n, v in a.items()) for k, a in self._table.items())

    __hash__ = None

    def keys(self) -> list[str]:
        return list(self._table)

    def copy(self) -> Meta:
        return copy.deepcopy(self)

    def drop(self, names: str | Iterable[str]) -> None:
        """Each name as a variable, else a label, else a header attribute; KeyError if it is none."""
        for name in [names] if isinstance(names, str) else names:
            if name in self:
                del self._table[self.name_of(name)]
            elif self.label_of(name) in self.labels:
                for row in self._table.values():
                    row.pop(self.label_of(name), None)
            elif name in self.header:
                del self.header[name]
            else:
                raise KeyError(name)

    def keep(self, names: Iterable[str]) -> None:
        names = {self.name_of(n) for n in names}
        self._table = {k: v for k, v in self._table.items() if k in names}

    def pop(self, name: str) -> dict:
        return self._table.pop(self.name_of(name))

    def rename(self, mapper: Mapping[str, str] | Callable[[str], str]) -> None:
        new = mapper if callable(mapper) else lambda k: mapper.get(k, k)
        self._table = {new(k): v for k, v in self._table.items()}

    def merge(self, other: Meta) -> None:
        """Adds what is missing; what is here stays."""
        for name in other.keys():
            if name not in self:
                self[name] = other[name]

    def concat(self, other: Meta, *, strict: bool = False) -> Meta:
        """A new table in which the other's variables win; with ``strict`` a shared name is a KeyError."""
        if strict and (both := [n for n in other.keys() if n in self]):
            raise KeyError(f"in both: {both}")
        out = self.copy()
        for name in other.keys():
            out[name] = other[name]
        out.header |= other.header
        return out

    def to_dict(self) -> dict[str, dict]:
        return copy.deepcopy(self._table)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per variable and label, as text."""
        return spark.createDataFrame([(k, n, None if v is None else str(v)) for k, row in self._table.items() for n, v in row.items()], "variable string, label string, value string")

    @classmethod
    def from_csv(cls, path: str, delimiter: str = ",") -> Meta:
        """A table with a first column of variable names and a header line of labels; columns named ``name`` or first."""
        with open(path, newline="") as f:
            read = list(csv.DictReader(f, delimiter=delimiter))
        first = "name" if read and "name" in read[0] else next(iter(read[0])) if read else "name"
        return cls({r.pop(first): r for r in read})
