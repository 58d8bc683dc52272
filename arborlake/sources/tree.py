"""A directory tree as a data source: ``spark.read.format("repo_tree").option("path", …)``.

Built-in file sources drop hidden and empty files and follow links, and the
signals of a repository lie exactly there; this reader lists them.  Each
folder below ``splitDepth`` levels is a partition of its own.

Options: ``path`` (roots, separated like search paths), ``splitDepth``,
``extensions`` (a comma-separated list; only such files are listed) and
``texts``: ``wanted`` (the default) reads the texts that rules look at, up to
the reading limit, ``all`` every text, ``none`` none.  Lines of source files
are counted in chunks, whatever the size and without keeping the text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arborlake.functions.paths import derive
from arborlake.plans import rules as R
from arborlake.plans.detectors import READ_EXTENSIONS, READ_NAMES, UNLIMITED_NAMES

_NEVER, _DOT = frozenset(R.IGNORED_FOLDERS), frozenset(R.KEPT_DOT_FOLDERS)
_READ, _READ_SUFFIXES, _COUNTED = frozenset(READ_NAMES), frozenset(READ_EXTENSIONS), frozenset(e for e, _ in R.EXT_TO_LANGUAGE)
SCHEMA = "repo_id string, path string, relative_path string, size bigint, lines bigint, content string"
_CHUNK = 1 << 20


def enters(name: str) -> bool:
    """Whether a scan goes into a folder of this name."""
    return name not in _NEVER and (not name.startswith(".") or name in _DOT)


@dataclass
class Part(InputPartition):
    repo_id: str
    root: str
    folder: str  # relative, '' for the top
    deep: bool  # whether to go into subfolders

    def __post_init__(self) -> None:
        super().__init__(None)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [os.path.abspath(p) for p in options["path"].split(os.pathsep)]
        self.split_depth = int(options.get("splitDepth", 2))
        self.texts = options.get("texts", "wanted")
        if self.texts not in ("wanted", "all", "none"):
            raise ValueError(f"texts is wanted, all or none, not {self.texts}")
        listed = [e.strip().lower() for e in options.get("extensions", "").split(",") if e.strip()]
        self.extensions = frozenset(listed) if listed else None

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        level = [(root, "") for root in self.roots]
        # folders are listed side by side; only those of the upper levels are listed here
        with ThreadPoolExecutor(32) as pool:
            for _ in range(self.split_depth):
                parts += [Part(root, root, folder, False) for root, folder in level]
                below = list(pool.map(lambda x: _subfolders(*x), level))
                level = [(root, child) for (root, _), children in zip(level, below) for child in children]
        return parts + [Part(root, root, folder, True) for root, folder in level]

    def read(self, partition: Part) -> Iterator[tuple]:
        pending = [partition.folder]
        while pending:
            folder = pending.pop()
            with _entries(os.path.join(partition.root, folder)) as entries:
                for entry in entries:
                    relative = f"{folder}/{entry.name}" if folder else entry.name
                    if entry.is_symlink():
                        continue
                    if entry.is_dir(follow_symlinks=False):
                        if partition.deep and enters(entry.name) and relative.count("/") + 1 <= R.MAX_DEPTH:
                            pending.append(relative)
                    elif entry.is_file(follow_symlinks=False):
                        suffix = os.path.splitext(entry.name)[1].lower()
                        if self.extensions is None or suffix in self.extensions:
                            size = entry.stat(follow_symlinks=False).st_size
                            lines = _line_count(entry.path) if suffix in _COUNTED and self.texts != "none" else None
                            yield partition.repo_id, entry.path, relative, size, lines, _text(entry.path) if self._reads(entry.name, suffix, size) else None

    def _reads(self, name: str, suffix: str, size: int) -> bool:
        if self.texts != "wanted":
            return self.texts == "all"
        return (name in _READ or suffix in _READ_SUFFIXES) and (size <= R.MAX_TEXT_BYTES or name in UNLIMITED_NAMES)


class _Nothing:
    def __enter__(self):
        return iter(())

    def __exit__(self, *_):
        return False


def _entries(path: str):
    try:
        return os.scandir(path)
    except OSError:
        return _Nothing()


def _subfolders(root: str, folder: str) -> list[str]:
    with _entries(os.path.join(root, folder)) as entries:
        found = [e.name for e in entries if not e.is_symlink() and e.is_dir(follow_symlinks=False) and enters(e.name)]
    return [f"{folder}/{n}" if folder else n for n in sorted(found)]


def _text(path: str) -> str | None:
    try:
        with open(path, "rb") as file:
            return file.read().decode("utf-8", "replace")
    except OSError:
        return None


def _line_count(path: str) -> int | None:
    """Line ends, and one more for a last line without one, read in chunks."""
    count, last = 0, b"\n"
    try:
        with open(path, "rb") as file:
            while chunk := file.read(_CHUNK):
                count += chunk.count(b"\n")
                last = chunk[-1:]
    except OSError:
        return None
    return count + (last != b"\n")


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, *paths: str, split_depth: int = 2, texts: str = "wanted", extensions: tuple[str, ...] = ()) -> DataFrame:
    """All files below the ``paths``, or those with the ``extensions``, one repository each, with derived columns."""
    spark.dataSource.register(TreeSource)
    options = {"path": os.pathsep.join(paths), "splitDepth": split_depth, "texts": texts, "extensions": ",".join(extensions)}
    return derive(spark.read.format("repo_tree").options(**options).load())
