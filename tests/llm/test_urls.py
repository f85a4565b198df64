"""URL judging against SQL for the rules and a plain tree for the templates."""

import math
import re
from collections import Counter

import pytest
from compare import connect

from pointerloom.llm import url_templates as T
from pointerloom.llm.queries import QUERIES, URL_RULES

HEX = re.compile(T.HEX_ID)

RULE_SQL = """
WITH a AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a
  FROM pages),
b AS (SELECT page_id, coalesce(regexp_extract(a, '^[^/?#]*'), '') AS raw,
             coalesce(regexp_extract(a, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
c AS (SELECT page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM b),
rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT c.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
         max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)
  GROUP BY c.page_id)
SELECT c.page_id, c.host, c.path, rule, verdict FROM c LEFT JOIN fits USING (page_id)"""


def plain_branches(shapes):
    """shape -> branch of one host, by recursion over whole lists of pages."""
    out = {}

    def walk(pages, branch, level):
        ended = [p for p in pages if len(p[1]) == level]
        for shape, _ in ended:
            out[shape] = branch
        onward = [p for p in pages if len(p[1]) > level]
        counts = Counter(p[1][level] for p in onward)
        groups = {}
        for p in onward:
            s = p[1][level]
            enough = counts[s] >= max(2, 0.05 * len(onward), 0.001 * len(shapes))
            groups.setdefault(s if enough or s in ("", "**") else "*", []).append(p)
        for s, below in groups.items():
            walk(below, f"{branch}/{s}", level + 1)

    walk([(s, s.split("/")[1:]) for s in shapes], "", 0)
    return out


def plain_shape(path):
    path = re.sub("[0-9]+", "#", HEX.sub("#", path)).replace("{", "%7B")
    parts = path.split("/")
    return path if len(parts) <= T.LEVELS + 1 else "/".join(parts[: T.LEVELS + 1]) + "/**"


def plain_verdicts(pages):
    """shape -> (template, purity, rejected) of one host from (shape, verdict) pairs, by nested tables."""
    branch_of = plain_branches([s for s, _ in pages])
    paths = Counter((tuple(branch_of[s].split("/")[1:]), v) for s, v in pages)

    def grouped(rows):
        """Nested (rows that end here, merged name -> below), and path -> template."""
        here, firsts = Counter(), {}
        for (path, v), n in rows.items():
            if path:
                firsts.setdefault(path[0], Counter())[path[1:], v] += n
            else:
                here[v] += n
        done = {name: grouped(below) for name, below in firsts.items()}
        renamed = {  # rows of a child under the templates its own merging gave
            name: Counter() for name in firsts
        }
        for name, below in firsts.items():
            for (path, v), n in below.items():
                renamed[name][done[name][path], v] += n
        groups = []
        for name in sorted(firsts, key=lambda x: (-firsts[x].total(), x)):
            fitting = [g for g in groups if name not in ("", "*", "**") and g[0][0] not in ("", "*", "**")
                       and like(g[1], renamed[name])]
            if fitting:
                fitting[0][0].append(name)
                fitting[0][1].update(renamed[name])
            else:
                groups.append(([name], Counter(renamed[name])))
        label = {x: names[0] if len(names) == 1 else "{" + "|".join(sorted(names)) + "}" for names, _ in groups for x in names}
        return {path: f"/{label[path[0]]}{done[path[0]][path[1:]]}" if path else "" for path, _ in rows}

    def like(a, b):
        n, m = a.total(), b.total()
        bound = math.sqrt(0.5 * math.log(40)) * (n ** -0.5 + m ** -0.5)
        for index, limit in ((0, bound), (1, 0.25)):
            x, y = Counter(), Counter()
            for source, into in ((a, x), (b, y)):
                for k, c in source.items():
                    into[k[index]] += c
            if any(abs(x[k] / n - y[k] / m) > limit for k in x | y):
                return False
        return True

    template = grouped(paths)
    out = {}
    for s, _ in pages:
        mine = template[tuple(branch_of[s].split("/")[1:])]
        below = Counter()
        for (path, v), n in paths.items():
            if template[path] == mine or template[path].startswith(mine + "/"):
                below[v] += n
        share = (below["block"] + 1) / (below["block"] + below["allow"] + 2)
        half = below["block"] + below["allow"] >= 0.5 * below.total()
        out[s] = (mine, round(share, 9), share >= 0.8 and half)
    return out


def expected(rows):
    """Judged rows of (page_id, host, path, rule, rule's verdict)."""
    by_host, out = {}, []
    for _, host, path, _, verdict in rows:
        by_host.setdefault(host, []).append((plain_shape(path), verdict))
    plain = {h: plain_verdicts(p) for h, p in by_host.items()}
    for key, host, path, rule, verdict in rows:
        template, share, rejected = plain[host][plain_shape(path)]
        out.append((key, host, path, rule, verdict or ("block" if rejected else "allow"), template, share))
    return sorted(out, key=str)


def collected(df):
    return sorted(((*r[:6], round(r[6], 9)) for r in map(tuple, df.collect())), key=str)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_like_plain(spark, folder):
    rows = connect(folder).sql(RULE_SQL).fetchall()
    assert collected(QUERIES["op11_url_templates"](spark, folder)) == expected(rows)


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM", "x://b.net?q", "x://b.net#f", "x://B.NeT/es/1/2?y=/z",
            "x://net/es/", "x://notnet/es/", "x://n.net/fr", "x://c.com/EN/é/a", "x://www.example.com/en/", "x://É.com/a://b/",
            "x://d.org/" + "/".join("abcdefghijklmno"), "x://d.org/" + "y" * 100_000, "x://d.org/0123456789abcdef/k.html",
            "x://d.org/{a|b}/1", "x://d.org/{a|b}/2"]
    urls += [f"x://n.net/fr/{k}" for k in range(9)] + [f"x://s.org/post/{w}" for w in "abcdefghijklmnopqrstuvwxyz"]
    urls += [f"x://m.net/{lang}/{k}" for lang in ("es", "fr", "de", "en") for k in range(40)] + ["x://m.net/es", "x://m.net"]
    rows = [(k if k % 7 else None, u, "other") for k, u in enumerate(urls)] + [(1, urls[7], "again")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(4)
    db = connect("/nowhere")
    db.register("pages", df.toPandas().reset_index(names="row").assign(page_id=lambda p: p["row"]))
    numbered = {r[0]: r[1:] for r in db.sql(RULE_SQL).fetchall()}
    ids = [r.page_id for r in df.collect()]
    plain = [(ids[k], *numbered[k]) for k in range(len(ids))]
    got = T.judge_urls(df, URL_RULES)
    assert collected(got) == expected(plain)
    found = {r.path: r for r in got.where("host = 'm.net'").collect()}
    assert found["/es/3"].template == found["/fr/3"].template == "/{es|fr}/#"
    assert found["/es"].verdict == "block" and found["/es"].rule is None
    assert found["/de/5"].verdict == found[""].verdict == "allow"
    assert {r.template for r in got.where("host = 's.org'").collect()} == {"/post/*"}
    assert T.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_united_branches_with_unlike_halves():
    """What is below a segment in one branch is found also where the other united it with more."""
    row = lambda branch, n, blocked=0: {"branch": branch, "n": n, "blocked": blocked, "allowed": 0}
    rows = [row("/x/a/p", 2), row("/x/b/q", 2), row("/x/e|f/q", 2), row("/x/d", 1), row("/y/a/c", 3), row("/y/*", 1)]
    got = {branch: template for branch, template, _, _ in T.host_templates(rows)}
    united = "/{x|y}/{a|b|d|e%7Cf}"
    assert got == {"/x/a/p": f"{united}/p", "/x/b/q": f"{united}/q", "/x/e|f/q": f"{united}/q", "/x/d": united,
                   "/y/a/c": f"{united}/c", "/y/*": "/{x|y}/*"}
