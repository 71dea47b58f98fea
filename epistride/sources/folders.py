"""Episode folders as a data source: a folder is read by one task, so that its order, repeats and broken lines need no exchange.

``spark.read.format("episode_folders").option("path", root)`` gives the lines of steps.jsonl under condition folders, and
``option("rows", "broken")`` those that are no JSON objects. Filters on task_dir and condition are pushed to the listing:
other folders are not opened. Paths are opened by pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from epistride.sources import ingest

NAME = "episode_folders"
LINES = "source_dir string, task_dir string, condition long, line long, step long, value string"
BROKEN = "source_dir string, task_dir string, condition long, line long, error string, value string"
MODES = ("strict", "lenient", "unique")
#: Bytes of files that one task reads, unless one file is longer; rows of an Arrow batch.
GROUP_BYTES = 64 << 20
BATCH_ROWS = 1000
_FOLDER = re.compile(r"(?:.*/)?([^/]*)/condition_([^/]*)/steps\.jsonl")


@dataclass(frozen=True)
class Folder:
    path: str  # of steps.jsonl, as its file system takes it
    source_dir: str
    task_dir: str
    condition: int | None
    size: int


@dataclass
class Group(InputPartition):
    folders: list[Folder]


def _opened(root: str):
    from pyarrow import fs

    root = re.sub(r"^s3[an]://", "s3://", root)
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class FolderReader(DataSourceReader):
    def __init__(self, root: str, mode: str, rows: str):
        self.root, self.mode, self.rows = root, mode, rows
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else tuple(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("task_dir",), ("condition",)):
                self.wanted.append((f.attribute[0], values))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Groups of folders by bytes, from a listing; only folders that the filters want."""
        from pyarrow import fs

        system, base = _opened(self.root)
        found = []
        for info in system.get_file_info(fs.FileSelector(base, recursive=True)):
            named = _FOLDER.fullmatch(info.path) if info.is_file else None
            if named:
                # As Spark names files: local paths and those of hdfs begin with a slash, of object stores with the bucket.
                prefix = "file:" if isinstance(system, fs.LocalFileSystem) else re.match(r"\w+://[^/]*" if info.path.startswith("/") else r"\w+://", self.root)[0]
                digits = named[2] if named[2].isdigit() else None
                found.append(Folder(info.path, prefix + info.path.removesuffix("/steps.jsonl"), named[1], int(digits) if digits else None, info.size))
        found = sorted((f for f in found if all(getattr(f, c) in values for c, values in self.wanted)), key=lambda f: f.path)
        groups: list[Group] = []
        size = GROUP_BYTES
        for f in found:
            if size + f.size > GROUP_BYTES:
                groups.append(Group([]))
                size = 0
            groups[-1].folders.append(f)
            size += f.size
        return groups or [Group([])]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.root)
        broken = self.rows == "broken"
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string() if broken else pa.int64(), pa.string()]
        names = [c.split()[0] for c in (BROKEN if broken else LINES).split(", ")]
        rows: list[tuple] = []
        for folder in partition.folders:
            for row in self._broken(system, folder) if broken else self._lines(system, folder):
                rows.append((folder.source_dir, folder.task_dir, folder.condition, *row))
                if len(rows) == BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    @staticmethod
    def _told(system, folder: Folder) -> Iterator[tuple[int, str, object, str | None]]:
        """Place in the file (from 1), text, step_id and error of each line that isn't blank."""
        with system.open_input_stream(folder.path) as f:
            for at, data in enumerate(_split(f), 1):
                text = data.decode(errors="replace").strip()
                if not text:
                    continue
                try:
                    value = json.loads(text)
                    error = None if isinstance(value, dict) else "not an object"
                except (ValueError, RecursionError) as e:
                    value, error = None, str(e) or type(e).__name__
                step = None if error else value.get("step_id")
                yield at, text, step if isinstance(step, int) and not isinstance(step, bool) else None, error

    def _broken(self, system, folder: Folder) -> Iterator[tuple[int, str, str]]:
        for at, text, _, error in self._told(system, folder):
            if error:
                yield at, error, text

    def _lines(self, system, folder: Folder) -> Iterator[tuple[int, int | None, str]]:
        """Number (of good lines, from 0), step and text. A lenient reader goes through the file twice, to know the last line of a step."""
        last: dict[int, int] = {}
        if self.mode == "lenient":
            good = (x for x in self._told(system, folder) if not x[3])
            last = {(n if step is None else step): n for n, (_, _, step, _) in enumerate(good)}
        seen: set[int] = set()
        n = -1
        for at, text, step, error in self._told(system, folder):
            if error and self.mode == "lenient":
                continue
            if error:
                raise ValueError(f"broken line {at} in {folder.source_dir}: {text[:80]}")
            n += 1
            if self.mode == "lenient":
                step = n if step is None else step
                if last[step] != n:
                    continue
            elif self.mode == "unique":
                if step in seen:
                    raise ValueError(f"step {step} occurs again in line {at} of {folder.source_dir}")
                if step is not None:
                    seen.add(step)
            yield n, step, text


def _split(f, size: int = 1 << 20) -> Iterator[bytes]:
    """Lines of a binary file, a piece of it at a time."""
    rest = b""
    while piece := f.read(size):
        *lines, rest = (rest + piece).split(b"\n")
        yield from lines
    if rest:
        yield rest


class EpisodeFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return BROKEN if self.options.get("rows") == "broken" else LINES

    def reader(self, schema) -> FolderReader:
        mode, rows = self.options.get("mode", "strict"), self.options.get("rows", "steps")
        if mode not in MODES or rows not in ("steps", "broken"):
            raise ValueError(f"mode must be one of {MODES}, and rows steps or broken")
        return FolderReader(self.options["path"], mode, rows)


def _read(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EpisodeFolders)
    return spark.read.format(NAME).options(path=root, **options).load()


def read_steps(spark: SparkSession, root: str, mode: str = "strict") -> DataFrame:
    """Steps of all condition folders below ``root``, as ``ingest.read_steps`` gives them, with task_dir and condition, which filters prune folders by.

    ``strict``: a broken line raises an error that names file and line. ``unique``: so does a step that occurs twice in a folder.
    ``lenient``: broken lines are left out (see ``broken_lines``), a missing step_id becomes the number of the line, and of
    lines with one step_id the last stays. Blank lines don't count; no folder gives no rows.
    """
    lines = _read(spark, root, mode=mode)
    names = [f.name for f in T._parse_datatype_string(ingest.STEP).fields]
    parsed = lines.withColumn("r", F.from_json("value", ingest.STEP))
    step = F.coalesce("r.step_id", "step") if mode == "lenient" else F.col("r.step_id")
    return parsed.select("source_dir", "task_dir", "condition", "line", *[step.alias(n) if n == "step_id" else F.col(f"r.{n}").alias(n) for n in names])


def broken_lines(spark: SparkSession, root: str) -> DataFrame:
    """source_dir, task_dir, condition, line (from 1), error and value of every line that is no JSON object."""
    return _read(spark, root, rows="broken")
