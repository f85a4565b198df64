"""Where the four log families lie under a data root, and which files to read.

A root and the usual places beside it are listed once; which place holds which
family is read off that one table.
"""

from __future__ import annotations

from dataclasses import dataclass
from fnmatch import fnmatchcase
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointerloom.schema import DATASET_DIRS, SOURCES
from pointerloom.sources.listing import existing, full_names, ignored_names, matching, refuse, walk

FILE_PATTERNS = {"CK": "*.csv", "HVT": "*.csv", "HMI": "*.csv", "AP": "*.json"}
LOGS = tuple(sorted(set(FILE_PATTERNS.values())))

# Name parts of the files explored first (fixed values).
PREFERRED_NAMES = {"HMI": ("raw_interactions", "sequences"), "AP": ("study", "data")}

COLUMNS = ["path", "file_path", "length", "modified"]


def _under(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}"


def _parent(path: str) -> str:
    return path.rstrip("/").rpartition("/")[0] or "/"


def _inside(root: str) -> list[str]:
    """Folders under a root that may hold the families."""
    return [root, _under(root, "raw"), _under(root, ".data/raw")]


def _usual(root: str, name: str) -> list[str]:
    """Usual places of one family, best first."""
    beside = _parent(root)
    return [
        *(_under(b, name) for b in _inside(root)),
        _under(beside, name),
        _under(_under(beside, "raw"), name),
    ]


def list_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Files below folders that exist, without their contents."""
    return walk(spark, full_names(spark, folders)).where("not ignored").select(*COLUMNS)


@dataclass(frozen=True)
class Listing:
    """One listing of a root and of the usual places beside it.

    ``held`` tells of each usual place whether files are below it, ``deeper`` has the
    first folder of a family's name at any depth of the root, ``ignored`` the logs
    that Spark leaves out. A place whose only logs are left out counts as filled, so
    that reading it names them.
    """

    spark: SparkSession
    root: str
    files: DataFrame
    full: dict[str, str]
    held: dict[str, bool]
    deeper: dict[str, str]
    ignored: list[str]

    def base(self) -> str:
        """The folder that holds the families: the root, or ``raw`` inside or beside it."""
        for base in (*_inside(self.root), _under(_parent(self.root), "raw")):
            if any(self.held.get(_under(base, n), False) for n in DATASET_DIRS.values()):
                return base
        return self.root

    def present(self) -> bool:
        return any(
            self.held.get(_under(b, n), False)
            for b in _inside(self.root)
            for n in DATASET_DIRS.values()
        )

    def folder(self, name: str) -> str:
        """Folder of one family: the first usual place with files, else any depth below."""
        for place in _usual(self.root, name):
            if self.held[place]:
                return place
        if self.deeper.get(name):
            return self.deeper[name]
        for path in self._ignored_below(self.full.get(self.root, self.root)):
            if f"/{name}/" in path:
                return _under(path[: path.index(f"/{name}/")], name)
        return _under(self.root, name)

    def _ignored_below(self, full: str) -> list[str]:
        return [p for p in self.ignored if p.startswith(_under(full, ""))]

    def family(self, name: str, pattern: str) -> DataFrame:
        """Files of one family that match; such as Spark leaves out stop it."""
        folder = self.folder(name)
        full = existing(self.spark, [folder]).get(folder)
        if full is None:
            return self.files.limit(0)
        if full in self._roads():
            # Below a folder that the listing of the root passes over.
            files = matching(walk(self.spark, [full]), pattern).select(*COLUMNS)
        else:
            refuse([p for p in self._ignored_below(full) if fnmatchcase(p.rpartition("/")[2], pattern)])
            files = self.files.where(F.startswith("path", F.lit(_under(full, ""))))
        return files.where(F.endswith("path", F.lit(pattern.removeprefix("*"))))

    def _roads(self) -> set[str]:
        """Folders on the way to a left-out file whose way there has a left-out name."""
        top = self.full.get(self.root, self.root)
        roads = set()
        for path in self._ignored_below(top):
            parts = path[len(_under(top, "")) :].split("/")[:-1]
            first = next((i for i, p in enumerate(parts) if p.startswith("_")), len(parts))
            roads |= {_under(top, "/".join(parts[: i + 1])) for i in range(first, len(parts))}
        return roads


def list_root(
    spark: SparkSession, root: str, names: tuple[str, ...] = tuple(DATASET_DIRS.values())
) -> Listing:
    """List a root once, with the places beside it that may hold the folders ``names``.

    One job over the listed files fills the small table of places; a place that is
    absent is empty, any other failure of the file system is one of the listing.
    """
    root = root.rstrip("/") or "/"
    beside = _parent(root)
    # What is hidden from a listing of the root, or lies beside it, is listed by its own name.
    tops = [root, _under(root, ".data/raw"), _under(beside, "raw"), *(_under(beside, n) for n in names)]
    usual = list(dict.fromkeys(p for n in names for p in [
        *_usual(root, n), *(_under(b, n) for b in (*_inside(root), _under(beside, "raw")))
    ]))
    full = existing(spark, list(dict.fromkeys(tops + usual)))
    listed = list(dict.fromkeys(full[t] for t in tops if t in full))
    found = walk(spark, listed)
    files, ignored = found.where("not ignored").select(*COLUMNS), ignored_names(found, LOGS)
    held = {p: p in full and any(x.startswith(_under(full[p], "")) for x in ignored) for p in usual}
    deeper: dict[str, str] = {}
    if listed:
        there = [p for p in usual if p in full]
        below = F.startswith("path", F.lit(_under(full.get(root, root), "")))
        quoted = {n: F.regexp_extract("path", rf"^(.*?/\Q{n}\E)/", 1) for n in names}
        seen = files.agg(
            *[F.bool_or(F.startswith("path", F.lit(_under(full[p], "")))).alias(f"p{i}") for i, p in enumerate(there)],
            *[F.min(F.when(below & (quoted[n] != ""), quoted[n])).alias(f"n{i}") for i, n in enumerate(names)],
        ).first()
        held |= {p: held[p] or bool(seen[f"p{i}"]) for i, p in enumerate(there)}
        deeper = {n: seen[f"n{i}"] for i, n in enumerate(names) if seen[f"n{i}"]}
    return Listing(spark, root, files, full, held, deeper, ignored)


def resolve_dataset_root(spark: SparkSession, root: str) -> str:
    """The folder that holds the log families: the root, or ``raw`` inside or beside it."""
    return list_root(spark, root).base()


def is_dataset_present(spark: SparkSession, root: str) -> bool:
    """Whether any log family has files under the root or its ``raw`` folders."""
    return list_root(spark, root).present()


def find_dataset_dir(spark: SparkSession, root: str, name: str) -> str:
    """Folder of one log family: the first usual place with files, else any depth below."""
    return list_root(spark, root, (name,)).folder(name)


def source_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """Readable files of the four families: ``source, path, file_path, length, modified``.

    The root is listed once, and the folder inside or beside it once that holds the families.
    """
    listed = list_root(spark, root)
    base = listed.base()
    if base != listed.root:
        listed = list_root(spark, base)
    parts = [
        listed.family(name, FILE_PATTERNS[source]).select(F.lit(source).alias("source"), "*")
        for source, name in DATASET_DIRS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def source_presence(catalogue: DataFrame) -> DataFrame:
    """Files, bytes and presence of each family; families without files included."""
    listed = catalogue.sparkSession.createDataFrame([(s,) for s in SOURCES], "source string")
    totals = catalogue.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes")
    )
    zero = F.lit(0).cast("long")
    return listed.join(totals, "source", "left").select(
        "source",
        F.coalesce("n_files", zero).alias("n_files"),
        F.coalesce("bytes", zero).alias("bytes"),
        F.col("n_files").isNotNull().alias("present"),
    )


def name_matches(source: str) -> Column:
    """Whether a file is one explored first: HMI by file name, AP by full path."""
    text = F.col("path")
    if source == "HMI":
        text = F.element_at(F.split(text, "/"), -1)
    parts = PREFERRED_NAMES.get(source)
    if not parts:
        return F.lit(True)
    return reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in parts])


def select_files(
    catalogue: DataFrame, source: str, max_files: int | None = None, preferred: bool = False
) -> DataFrame:
    """Files of one family in path order, the first ``max_files`` if that is not 0.

    ``preferred`` keeps the files explored first, or all if none has such a name.
    """
    files = catalogue.where(F.col("source") == source)
    if preferred:
        match = name_matches(source)
        any_match = files.select(F.coalesce(F.bool_or(match), F.lit(False))).scalar()
        files = files.where(match | ~any_match)
    return files.orderBy("path").limit(max_files) if max_files else files
