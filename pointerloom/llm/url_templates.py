"""URL filtering by rules where one fits, and by path templates where none does.

The paths of a host make a tree of segments. Numbers and ids are wildcards from the
start; a segment that too few pages of its place share becomes one too. Branches that
look alike, in the templates below them and in how the rules judge their pages, are one
branch. Pages that rules judge are the labelled ones: a template is rejected if its
branch is mostly judged and the smoothed share of blocked pages among the judged is high.

The tree grows by a level at a time from counts of distinct shapes, so a host with a
third of all pages is no more work for a task than others.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import groupby
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointerloom.llm.common import written

Rule = tuple[str, str]

#: Segments that make a level of the tree; what is deeper is one last segment.
LEVELS = 8
REST, ANY = "**", "*"
#: A segment of a node stays if at least this share of its pages has it, and this many.
LEAST_SHARE = 0.05
LEAST_PAGES = 2
#: And this share of the host's pages, which bounds the tree of a host.
HOST_SHARE = 0.001
#: Chance of taking like branches for unlike ones, and how far judged shares may differ.
ALPHA = 0.05
TOLERANCE = 0.25
#: Pseudo-counts of a purity, half of them blocked; purity and judged share that reject.
SMOOTHING = 2.0
REJECT_AT = 0.8
LEAST_JUDGED = 0.5

# Ids of hexadecimal digits, as a whole segment or up to its extension.
HEX_ID = r"(?<=/)(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{8,}(?=[/.]|$)"

TREE = "host string, branch string, template string, purity double, rejected boolean"
TREE_FIELDS = pa.schema(
    [("host", pa.string()), ("branch", pa.string()), ("template", pa.string()),
     ("purity", pa.float64()), ("rejected", pa.bool_())]
)


def with_address(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path`` of a URL; both empty where it is null or has no ``://``."""
    address = F.expr(f"if(locate('://', `{url}`) > 0, substr(`{url}`, locate('://', `{url}`) + 3), '')")
    address = F.coalesce(address, F.lit(""))
    host = F.regexp_extract(address, r"^[^/?#]*", 0)
    return pages.withColumns(
        {
            "host": F.translate(host, ascii_uppercase, ascii_lowercase),
            "path": F.regexp_extract(address, r"^[^/?#]*([^?#]*)", 1),
        }
    )


def rule_of(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path`` and its verdict, null without one.

    Of rules of equal length that fit, the one with the longer host wins, then ``block``.
    """
    split = [(pattern, verdict, *pattern.partition("/")[::2]) for verdict, pattern in rules]
    split.sort(key=lambda r: (-len(r[0]), -len(r[2]), r[1] != "block", r[0]))
    found = verdict_of = F.lit(None).cast("string")
    for pattern, verdict, host, path in reversed(split):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col(
            "path"
        ).startswith(f"/{path}")
        found = F.when(fits, F.lit(pattern)).otherwise(found)
        verdict_of = F.when(fits, F.lit(verdict)).otherwise(verdict_of)
    return found, verdict_of


def shape_of(path: Column, levels: int = LEVELS) -> Column:
    """A path with ``#`` for ids and runs of digits, cut to its first segments.

    An opening brace is written as its code, as braces name united branches.
    """
    ids = F.regexp_replace(F.regexp_replace(path, HEX_ID, "#"), "[0-9]+", "#")
    plain = F.replace(ids, F.lit("{"), F.lit("%7B"))
    head = F.substring_index(plain, "/", levels + 1)
    return F.when(head == plain, plain).otherwise(F.concat(head, F.lit(f"/{REST}")))


def grow_templates(shapes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Add ``branch``, the generalised path of every ``host, shape`` with counts ``n``.

    A level counts the segments at every node reached so far and keeps those with enough
    pages; all others of the node become ``*``. Both are sums over shapes, not pages.
    """
    hosts = shapes.groupBy("host").agg((F.sum("n") * HOST_SHARE).alias("_host"))
    segments = F.split(F.expr("substr(shape, 2)"), "/")
    grown = shapes.withColumns(
        {"_segments": F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(segments),
         "branch": F.lit("")}
    )
    deepest = grown.agg(F.max(F.size("_segments"))).first()[0] or 0
    for level in range(min(deepest, levels + 1)):
        here = F.col("_segments")[level]
        seen = grown.withColumn("_here", F.when(F.size("_segments") > level, here))
        children = seen.where("_here is not null").groupBy("host", "branch", "_here").agg(F.sum("n").alias("_n"))
        nodes = seen.where("_here is not null").groupBy("host", "branch").agg(
            (F.sum("n") * LEAST_SHARE).alias("_node")
        )
        enough = F.col("_n") >= F.greatest(F.lit(float(LEAST_PAGES)), "_node", "_host")
        marks = F.col("_here").isin("", REST)
        kept = (
            children.join(nodes, ["host", "branch"])
            .join(hosts, "host")
            .where(enough | marks)
            .select("host", "branch", "_here", F.col("_here").alias("_kept"))
        )
        step = F.concat("branch", F.lit("/"), F.coalesce("_kept", F.lit(ANY)))
        grown = written(
            seen.join(kept, ["host", "branch", "_here"], "left")
            .withColumn("branch", F.when(F.col("_here").isNotNull(), step).otherwise(F.col("branch")))
            .drop("_here", "_kept"),
            "templates",
        )
    return grown.drop("_segments")


class Node:
    """A place in the tree of a host: pages that end here by verdict, and what is below.

    ``names`` are the segments that lead here; children have none in common.
    """

    def __init__(self, *names: str):
        self.here: Counter = Counter()
        self.children: dict[frozenset[str], Node] = {}
        self.names = frozenset(names)

    def label(self) -> str:
        """The segment that leads here, or all of them in braces, bars in them as codes."""
        names = sorted(self.names)
        return names[0] if len(names) == 1 else f"{{{'|'.join(n.replace('|', '%7C') for n in names)}}}"

    def add(self, other: Node) -> None:
        """Take the names and pages of another branch, place by place."""
        self.here.update(other.here)
        self.names |= other.names
        for child in other.children.values():
            self.take(child)

    def take(self, child: Node) -> None:
        """Put a branch below, as one with all that share a segment with it."""
        for names, own in list(self.children.items()):
            if names & child.names:
                del self.children[names]
                own.add(child)
                child = own
        self.children[child.names] = child

    def below(self, name: str) -> Node:
        """The branch that a segment leads to."""
        return next(child for names, child in self.children.items() if name in names)

    def profile(self) -> Counter:
        """Pages by template below this place."""
        out = Counter({"": self.here.total()})
        for child in self.children.values():
            out.update({f"/{child.label()}{rest}": n for rest, n in child.profile().items()})
        return out

    def judged(self) -> Counter:
        """Pages at and below this place by verdict."""
        return sum((c.judged() for c in self.children.values()), Counter(self.here))


def alike(a: tuple[Counter, Counter], b: tuple[Counter, Counter]) -> bool:
    """Whether two (profile, verdicts) cannot be told apart.

    Shares of templates may differ by the Hoeffding bound of both numbers of pages;
    shares of verdicts by ``TOLERANCE`` at most, however few pages there are.
    """
    (shape_a, judged_a), (shape_b, judged_b) = a, b
    n, m = shape_a.total(), shape_b.total()
    bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
    apart = lambda x, y, key: abs(x[key] / n - y[key] / m)
    return all(apart(shape_a, shape_b, k) <= bound for k in shape_a | shape_b) and all(
        apart(judged_a, judged_b, k) <= TOLERANCE for k in judged_a | judged_b
    )


def merge_branches(node: Node) -> None:
    """Unite branches below a node that are alike, from the bottom up.

    Branches come by descending size, then name; each joins the first group that is
    alike to all it holds so far. Places that a segment leads to in both become one, with
    all they hold. Wildcards and ends of paths stay apart.
    """
    for child in node.children.values():
        merge_branches(child)
    groups: list[Node] = []
    rest = []
    for child in sorted(node.children.values(), key=lambda c: (-c.judged().total(), c.label())):
        if child.label() in ("", ANY, REST):
            rest.append(child)
            continue
        own = child.profile(), child.judged()
        like = next((g for g in groups if alike((g.profile(), g.judged()), own)), None)
        if like is None:
            groups.append(child)
        else:
            like.add(child)
    node.children = {branch.names: branch for branch in rest + groups}


def purity(judged: Counter) -> float:
    """Smoothed share of blocked pages among the judged."""
    return (judged["block"] + SMOOTHING / 2) / (judged["block"] + judged["allow"] + SMOOTHING)


def host_templates(rows: Sequence[dict]) -> Iterator[tuple]:
    """``branch, template, purity, rejected`` of a host from counts per branch."""
    root = Node()
    for row in rows:
        node = root
        for name in row["branch"].split("/")[1:]:
            node = node.children.setdefault(frozenset((name,)), Node(name))
        node.here.update(
            {"block": row["blocked"], "allow": row["allowed"], None: row["n"] - row["blocked"] - row["allowed"]}
        )
    merge_branches(root)
    for row in rows:
        node, template = root, ""
        for name in row["branch"].split("/")[1:]:
            node = node.below(name)
            template = f"{template}/{node.label()}"
        judged = node.judged()
        share = purity(judged)
        covered = judged["block"] + judged["allow"] >= LEAST_JUDGED * judged.total()
        yield row["branch"], template, share, share >= REJECT_AT and covered


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for row in batch.to_pylist())
    held: dict[str, list] = defaultdict(list)
    for host, branches in groupby(rows, key=lambda r: r["host"]):
        for found in host_templates(list(branches)):
            for name, value in zip(TREE_FIELDS.names, (host, *found)):
                held[name].append(value)
        if len(held["host"]) >= 4096:
            yield pa.RecordBatch.from_pydict(held, schema=TREE_FIELDS)
            held.clear()
    if held:
        yield pa.RecordBatch.from_pydict(held, schema=TREE_FIELDS)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", key: str = "page_id") -> DataFrame:
    """Every page with ``host, path, rule, verdict``, its ``template`` and ``purity``.

    ``rules`` are (``allow`` or ``block``, ``host/path``). A rule fits its host and all
    subdomains where the path starts with its path; the longest decides. Where none
    fits the template of the path does: ``block`` if it is rejected, else ``allow``.
    Pages go where their URL is read but for one join with the templates; that join's
    hot keys Spark splits, as the templates of a host are bounded.

    A null URL or one without ``://`` has an empty host and path and is judged with its
    like. Repeated and null ids stay rows of their own. An empty table gives no rows.
    Other columns are left out.
    """
    rule, verdict = rule_of(rules)
    placed = (
        with_address(pages.select(F.col(key), F.col(url).cast("string").alias("_url")), "_url")
        .drop("_url")
        .withColumns({"rule": rule, "_verdict": verdict, "shape": shape_of(F.col("path"))})
    )
    counted = lambda v: F.count(F.when(F.col("_verdict") == v, True))
    shapes = written(
        placed.groupBy("host", "shape").agg(
            F.count(F.lit(1)).alias("n"), counted("block").alias("blocked"), counted("allow").alias("allowed")
        ),
        "shapes",
    )
    grown = grow_templates(shapes)
    branches = grown.groupBy("host", "branch").agg(
        *[F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]
    )
    ordered = branches.repartition("host").sortWithinPartitions("host", "branch")
    trees = ordered.mapInArrow(_trees, TREE)
    templates = written(
        grown.select("host", "shape", "branch").join(trees, ["host", "branch"]).drop("branch"), "trees"
    )
    learned = F.when(F.col("rejected"), "block").otherwise("allow")
    return placed.join(templates, ["host", "shape"]).select(
        key, "host", "path", "rule", F.coalesce("_verdict", learned).alias("verdict"), "template", "purity"
    )
