"""S1 as a registered format: ``spark.read.format("keelson_dump").load(path)`` and ``USING keelson_dump``.

A Python data source over whole files. Input partitions are groups of files of about
``partitionBytes``; each file is read line by line with the lexical rules of :mod:`dumplex` and its
rows leave as Arrow batches. The schema is fixed and known without a read. Comparisons of
``timestamp`` with a constant are pushed into the reader, which drops rows before they reach Spark; Spark checks them again.

Only the open spell's table is held (16 bytes an entry), as its repeated keys must meet. Files so large that
one should be spread over tasks are for :func:`keelson.read_event_dump`, which reads any split of a file.

Paths: local ones, with wildcards, and any URI that ``pyarrow.fs`` opens (``hdfs://``, ``s3://``, ``gs://``).
"""

from __future__ import annotations

import fnmatch
import glob
import io
import json
import os
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition,
                                    LessThan, LessThanOrEqual)
from pyspark.sql.types import StructType

from keelson.sources import dumplex as lex
from keelson.sources.eventdump import ACTION_SECTION, DAMAGE_SECTION, DEFAULT_ROOT, EVENT_DUMP_SCHEMA

FORMAT = "keelson_dump"
_ROWS = 10_000
_entry, _open_keyed, _item = (re.compile(x) for x in (lex.ENTRY, lex.OPEN_KEYED, lex.ITEM))
_name, _scalar = re.compile(lex.NAME), re.compile(f"(?s){lex.NUMBER}|{lex.NAME}|{lex.STRING}")
_ARROW = pa.schema([
    ("timestamp", pa.timestamp("us", "UTC")), ("action", pa.struct([pa.field("spellId", pa.int64(), False)])),
    ("damage", pa.struct([pa.field("spellId", pa.int64(), False), pa.field("amount", pa.int64(), False)]))])


class DumpError(ValueError):
    """Something in a dump that is outside its grammar."""


def _key_before(past: deque, eq: int) -> str | None:
    """The key whose ``=`` stands ``eq`` tokens back, as written."""
    back = lambda k: past[-k] if len(past) >= k else None
    if back(eq) != "=":
        return None
    if back(eq + 1) == "]" and back(eq + 3) == "[":
        return back(eq + 2)
    name = back(eq + 1)
    return name if name and _name.fullmatch(name) and back(eq + 2) != "." else None


def _plain(key: str | None) -> str | None:
    return key[1:-1] if key and key[0] in "\"'" else key


def _whole(text: str | None) -> int | None:
    """The whole number that ``text`` stands for; null for anything else."""
    try:
        return int(text)
    except (TypeError, ValueError):
        try:
            number = float(text)
        except (TypeError, ValueError):
            return None
        return int(number) if number == number // 1 else None


def tables(lines: Iterator[str], root: str) -> Iterator[tuple[str, list, str | None, str | None, str]]:
    """``(kind, keys of the open tables, key, value, line)`` of what stands inside ``root``: open, close, entry, fault."""
    state, past, keys = "", deque(maxlen=6), []
    for line in lines:
        tokens, state = lex.lex_line(line, state)
        for t in tokens:
            before = past[-1] if past else None
            text = t[0] in "\"'"
            starts = before is None or before[0] not in "\"'" and before[-1] in "{,;"
            kind, key, value = None, None, None
            if not text and (found := _entry.fullmatch(t)):
                kind, key, value = ("entry" if starts else "fault"), found[1], found[2]
            elif not text and t.endswith("{"):
                found = _open_keyed.fullmatch(t)
                kind = "open" if starts or not found and before == "=" else "fault"
                key = found[1] if found else _key_before(past, 1)
            elif not text and (found := _item.fullmatch(t)):
                kind, key, value = ("entry" if starts or before == "=" else "fault"), _key_before(past, 1), found[1]
            elif t in ",;}":
                if before is not None and _scalar.fullmatch(before):
                    kind, key, value = "entry", _key_before(past, 2), before
                elif before in ("=", "[", "]") or t != "}" and before != "}":
                    kind = "fault"
            elif t == "=":
                kind = None if before == "]" or before and _name.fullmatch(before) else "fault"
            elif t == "[":
                kind = None if starts else "fault"
            elif t == "]":
                kind = None if len(past) > 1 and past[-2] == "[" else "fault"
            elif _scalar.fullmatch(t):
                kind = None if starts or before in ("=", "[") else "fault"
            else:
                kind = "fault"
            if kind and keys and keys[0] == root:
                yield kind, keys, _plain(key), value, line
            if not text and t.endswith("{"):
                keys.append(_plain(key))
            elif t == "}":
                if keys and keys[0] == root:
                    yield "close", keys, None, None, line
                keys = keys[:-1]
            past.append(t)


def _last_of_each(keys: list[int], values: list) -> tuple[np.ndarray, list]:
    """The last value of every key, in the order of these."""
    found = np.array(keys, np.int64)
    _, at = np.unique(found[::-1], return_index=True)
    at = np.sort(len(found) - 1 - at)
    return found[at], [values[i] for i in at.tolist()]


def events(lines: Iterator[str], root: str, errors: str, unknown_sections: str, where: str) -> Iterator[tuple[bool, int, np.ndarray, list]]:
    """``(is damage, spell, times, amounts)`` per table of a spell."""
    times, values, keyed = [], [], {}

    def fail(line: str) -> None:
        if errors == "raise":
            raise DumpError(f"event dump: cannot read a line of {where}: {line}")

    for kind, keys, key, value, line in tables(lines, root):
        section = keys[1] if len(keys) > 1 else None
        known = section is None or section in (ACTION_SECTION, DAMAGE_SECTION)
        if kind == "open":
            if len(keys) == 1 and unknown_sections == "raise" and key not in (ACTION_SECTION, DAMAGE_SECTION):
                fail(line)
            if known and len(keys) > 2:
                fail(line)
        elif kind == "close":
            if len(keys) == 3 and known:
                spell = _whole(keys[2])
                if section == ACTION_SECTION:
                    found = times + [v for v in keyed.values() if v is not None]
                    if found:
                        yield False, spell, np.array(found, np.int64), []
                elif times:
                    at, amounts = _last_of_each(times, values)
                    kept = [i for i, v in enumerate(amounts) if v is not None]
                    yield True, spell, at[kept], [amounts[i] for i in kept]
                times, values, keyed = [], [], {}
        elif known:
            spell = _whole(keys[2]) if len(keys) == 3 else None
            number, at = _whole(value), _whole(key)
            if kind == "fault" or spell is None or number is None and value != "nil":
                fail(line)
            elif section == ACTION_SECTION:
                if key is None:
                    times.extend([] if number is None else [number])
                else:
                    keyed[key] = number
            elif at is None:
                fail(line)
            else:
                times.append(at)
                values.append(number)


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: list[str]


def _open(path: str):
    if "://" in path:
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        return fs.open_input_stream(inner)
    return pa.input_stream(path)


def _listed(path: str) -> list[tuple[str, int]]:
    """Files under a path or wildcard with their sizes; names that begin with ``.`` or ``_`` are left out."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    shown = lambda p: os.path.basename(p)[:1] not in (".", "_")
    if "://" not in path:
        found = []
        for p in sorted(glob.glob(path)):
            inside = [os.path.join(d, f) for d, _, files in os.walk(p) for f in files] if os.path.isdir(p) else [p]
            found += [(f, os.path.getsize(f)) for f in sorted(inside) if shown(f)]
    else:
        head = path.split("*")[0].rpartition("/")[0] if "*" in path else path
        fs, inner = pyarrow.fs.FileSystem.from_uri(head)
        scheme = path.split("://")[0] + "://"
        infos = [fs.get_file_info(inner)]
        if infos[0].type == pyarrow.fs.FileType.Directory:
            infos = fs.get_file_info(pyarrow.fs.FileSelector(inner, recursive=True))
        tail = path[len(head):]
        authority = head[len(scheme):].partition("/")[0] if not inner.startswith(head[len(scheme):].partition("/")[0]) else ""
        found = [(scheme + authority + i.path, i.size) for i in infos if i.is_file and shown(i.path)
                 and ("*" not in path or fnmatch.fnmatch(i.path, inner + tail))]
    if not found:
        raise FileNotFoundError(f"no such path: {path}")
    return found


class EventDumpReader(DataSourceReader):
    def __init__(self, options: dict):
        paths = options.get("paths")
        self.paths = json.loads(paths) if paths else [options["path"]] if options.get("path") else []
        if not self.paths:
            raise ValueError("Path is required")
        self.root = options.get("root", DEFAULT_ROOT)
        self.errors = options.get("errors", "raise")
        self.unknown_sections = options.get("unknownsections", options.get("unknownSections", "ignore"))
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", 32 << 20)))
        if self.errors not in ("raise", "drop") or self.unknown_sections not in ("ignore", "raise"):
            raise ValueError("errors must be 'raise' or 'drop', unknownSections 'ignore' or 'raise'")
        self.bounds: list[tuple[str, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of the time with a constant are kept for the scan; all of them stay with Spark too."""
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualTo: "="}
        for f in filters:
            if type(f) in signs and f.attribute == ("timestamp",) and getattr(f.value, "tzinfo", None) is not None:
                self.bounds.append((signs[type(f)], round(f.value.timestamp() * 1_000_000)))
            yield f

    def partitions(self) -> list[Files]:
        groups, size = [[]], 0
        for path, length in (x for p in self.paths for x in _listed(p)):
            if groups[-1] and size + length > self.partition_bytes:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += length
        return [Files(g) for g in groups]

    def _kept(self, ms: np.ndarray) -> np.ndarray:
        us, keep = ms * 1000, np.ones(len(ms), bool)
        for sign, bound in self.bounds:
            keep &= {">": us > bound, ">=": us >= bound, "<": us < bound, "<=": us <= bound, "=": us == bound}[sign]
        return np.flatnonzero(keep)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            with _open(path) as raw, io.TextIOWrapper(raw, "utf-8", errors="replace") as lines:
                stripped = (line.removesuffix("\n") for line in lines)
                for damage, spell, ms, amounts in events(stripped, self.root, self.errors, self.unknown_sections, path):
                    kept = self._kept(ms)
                    for at in range(0, len(kept), _ROWS):
                        yield self._batch(damage, spell, ms, amounts, kept[at:at + _ROWS])

    @staticmethod
    def _batch(damage: bool, spell: int, ms: np.ndarray, amounts: list, at: np.ndarray) -> pa.RecordBatch:
        spells = pa.array(np.full(len(at), spell, np.int64))
        none = lambda i: pa.nulls(len(at), _ARROW.field(i).type)
        fields = lambda i: list(_ARROW.field(i).type)
        columns = ([none(1), pa.StructArray.from_arrays([spells, pa.array([amounts[i] for i in at.tolist()], pa.int64())], fields=fields(2))] if damage
                   else [pa.StructArray.from_arrays([spells], fields=fields(1)), none(2)])
        return pa.RecordBatch.from_arrays([pa.array(ms[at] * 1000).cast(_ARROW.field(0).type), *columns], schema=_ARROW)


class EventDumpSource(DataSource):
    """Options: ``path``, ``root``, ``errors`` (raise, drop), ``unknownSections`` (ignore, raise), ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return EVENT_DUMP_SCHEMA

    def reader(self, schema: StructType) -> EventDumpReader:
        return EventDumpReader(dict(self.options))


def register_event_dump(spark: SparkSession) -> None:
    """Make the format known to a session; registering it again is harmless.

    Spark refuses a reader that takes filters unless their pushdown is on, so it is switched on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EventDumpSource)
