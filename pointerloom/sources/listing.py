"""Which places exist, which files are below them, and which of these Spark's readers pass over.

Files of a file system that tasks can open are listed by tasks, folder by folder, into a
table: neither names nor sizes of files pass through the driver. Other file systems are
listed by Spark's own index, which stands in the driver.

A listing by Spark leaves out names that begin with ``_``, also where such a file
is given by its path, and all below a folder of such a name. Names that begin
with a dot are hidden and not meant to be read.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointerloom.operators.skew import materialise

# Names worth a look; ``left_out`` decides.
_SUSPECT = "{_*,*._COPYING_}"
# Names of summary files that Spark reads, and of unfinished copies (fixed values).
_SUMMARIES = ("_metadata", "_common_metadata")
_UNFINISHED = "._COPYING_"

# Characters that may be coded in a URL.
_ODD = re.compile(r"""[^!$&-;=@-Z_a-z~]""")

# Names of files and folders that a task lists below a given folder before it leaves
# further folders to other tasks, and rows that it hands over at once.
NEAR, ROWS = 10_000, 10_000

FILE_SCHEMA = "path string, file_path string, length long, modified timestamp, ignored boolean"
_FOUND = pa.schema([
    ("path", pa.string()), ("file_path", pa.string()), ("length", pa.int64()),
    ("modified", pa.timestamp("us", tz="UTC")), ("ignored", pa.bool_()), ("folder", pa.bool_()),
])


def left_out(name: str) -> bool:
    """Whether Spark passes over a file or folder of this name, hidden ones included.

    A partition folder such as ``_k=1`` is read.
    """
    if name.startswith(_SUMMARIES):
        return False
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith(_UNFINISHED)


def _located(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def existing(spark: SparkSession, places: list[str]) -> dict[str, str]:
    """Full names, with the scheme of their file system, of the places that exist."""
    found = {}
    for place in places:
        fs, path = _located(spark, place)
        if fs.exists(path):
            found[place] = fs.makeQualified(path).toString()
    return found


def full_names(spark: SparkSession, places: str | list[str]) -> list[str]:
    """Full names of places; one that does not exist is a pattern for such as do."""
    found: list[str] = []
    for place in [places] if isinstance(places, str) else places:
        fs, path = _located(spark, place)
        if fs.exists(path):
            names = [fs.makeQualified(path).toString()]
        else:
            names = [status.getPath().toString() for status in fs.globStatus(path) or []]
        if not names:
            raise FileNotFoundError(f"no such place: {place}")
        found += names
    return list(dict.fromkeys(found))


def opened_by_tasks(places: list[str]) -> bool:
    """Whether tasks can open all these places, given by their full names, like any local file."""
    return all(p.startswith("file:/") for p in places)


def local_name(full: str) -> str:
    return re.sub("^file:/+", "/", full)


def url_of(name: str) -> str:
    """A full name as Spark's readers give it for the file of a row: coded where a URL needs it."""
    if not _ODD.search(name):
        return f"file:{name}"
    stays = lambda c: not c.isascii() and unicodedata.category(c) not in ("Cc", "Zs", "Zl", "Zp")
    return "file:" + "".join(c if stays(c) else quote(c, safe="/_-!.~'()*,;:$&+=@") for c in name)


def _below(top: str, ignored: bool, near: int) -> Iterator[tuple]:
    """Files at or below a place, and the folders there that are left to other tasks."""

    def row(name: str, status: os.stat_result | None, off: bool) -> tuple:
        if status is None:
            return f"file:{name}", None, None, None, off, True
        return f"file:{name}", url_of(name), status.st_size, status.st_mtime_ns // 1_000_000 * 1000, off, False

    if not os.path.isdir(top):
        name = os.path.basename(top)
        if not name.startswith("."):
            yield row(top, os.stat(top), ignored or left_out(name))
        return
    todo = [(top, ignored)]
    while todo:
        folder, off = todo.pop()
        if near <= 0 and folder != top:
            yield row(folder, None, off)
            continue
        with os.scandir(folder) as entries:
            for entry in entries:
                if entry.name.startswith("."):
                    continue
                near -= 1
                out = off or left_out(entry.name)
                if entry.is_dir():
                    todo.append((entry.path, out))
                    continue
                try:
                    yield row(entry.path, entry.stat(), out)
                except FileNotFoundError:  # gone meanwhile, or a link to nowhere
                    continue


def _look(near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, ignored in zip(batch.column("path").to_pylist(), batch.column("ignored").to_pylist()):
                rows = _below(local_name(top), ignored, near)
                while some := list(islice(rows, ROWS)):
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*some), _FOUND)]
                    yield pa.RecordBatch.from_arrays(columns, schema=_FOUND)

    return run


def _by_tasks(spark: SparkSession, places: list[str]) -> DataFrame:
    """Files below places, a job per some levels of folders; the driver knows only how many folders are left."""
    tasks = spark.sparkContext.defaultParallelism
    todo = spark.createDataFrame([(p, False) for p in places], "path string, ignored boolean")
    todo = todo.coalesce(min(len(places), tasks))
    rounds = []
    while True:
        found = materialise(todo.mapInArrow(_look(NEAR), f"{FILE_SCHEMA}, folder boolean"))
        rounds.append(found.where("not folder").drop("folder"))
        more = found.where("folder").select("path", "ignored")
        left = more.count()
        if not left:
            return reduce(DataFrame.unionByName, rounds)
        todo = more.repartition(min(left, 4 * tasks))


def _by_spark(spark: SparkSession, places: list[str]) -> DataFrame:
    """The same by Spark's index of files, which stands in the driver until it is written."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    read = reader.load(places).select(
        "path",
        F.col("_metadata.file_path").alias("file_path"),
        "length",
        F.col("modificationTime").alias("modified"),
        F.lit(False).alias("ignored"),
    )
    off = [(p, p, None, None, True) for p in _suspects(spark, places)]
    return materialise(read).unionByName(spark.createDataFrame(off, FILE_SCHEMA))


def walk(spark: SparkSession, places: list[str]) -> DataFrame:
    """Files at or below places that are given by their full names, hidden ones left out.

    ``ignored`` are those that Spark's readers leave out by a name on their way.
    """
    if not places:
        return spark.createDataFrame([], FILE_SCHEMA)
    return _by_tasks(spark, places) if opened_by_tasks(places) else _by_spark(spark, places)


def _suspects(spark: SparkSession, places: list[str]) -> list[str]:
    """Full names of files at or below ``places`` that Spark would leave out.

    Folders are listed level by level in the JVM; only suspect names come to Python.
    """
    make = spark._jvm.org.apache.hadoop.fs.Path
    found: set[str] = set()

    def take(path, start: int) -> None:
        if not any(p.startswith(".") for p in path.toUri().getPath().split("/")[start:]):
            found.add(path.toString())

    def below(fs, base, depth: int) -> None:
        for status in fs.globStatus(make(base, _SUSPECT)) or []:
            path = status.getPath()
            if not left_out(path.getName()):
                continue
            start = path.depth() - depth
            if status.isFile():
                take(path, start)
                continue
            files = fs.listFiles(path, True)
            while files.hasNext():
                take(files.next().getPath(), start)

    for place in places:
        fs, root = _located(spark, place)
        for status in fs.globStatus(root) or []:
            path = status.getPath()
            if status.isFile() and left_out(path.getName()):
                take(path, path.depth())
        base, depth = root, 0
        # An empty level ends it; files have nothing below them.
        while len(fs.globStatus(base) or []):
            below(fs, base, depth)
            base, depth = make(base, "*"), depth + 1
    return sorted(found)


def _like(name: str, patterns: str | tuple[str, ...]) -> bool:
    wanted = (patterns,) if isinstance(patterns, str) else patterns
    return any(fnmatchcase(name.rpartition("/")[2], p) for p in wanted)


def ignored_names(files: DataFrame, patterns: str | tuple[str, ...]) -> list[str]:
    """Full names of files of a walk that match and that Spark would leave out, in order."""
    names = {r.path for r in files.where("ignored").select("path").collect()}
    return sorted(n for n in names if _like(n, patterns))


def refuse(names: list[str]) -> None:
    """Stop if there are such files, and name them all."""
    if names:
        raise ValueError(
            "Spark does not read files or folders whose names begin with '_'; rename: "
            + ", ".join(names)
        )


def matching(files: DataFrame, pattern: str) -> DataFrame:
    """Files of a walk whose names match ``*`` and an ending; such as Spark leaves out stop it."""
    refuse(ignored_names(files, pattern))
    return files.where(~F.col("ignored") & F.endswith("path", F.lit(pattern.removeprefix("*"))))


def refuse_ignored(spark: SparkSession, places: list[str], pattern: str) -> None:
    """Stop if Spark's readers would leave out matching files, and name them all."""
    refuse([n for n in _suspects(spark, places) if _like(n, pattern)])
