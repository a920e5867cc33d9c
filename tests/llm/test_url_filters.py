"""URL filters: rules, links, classes of aliases, against SQL and a plain union-find."""

import duckdb
import numpy as np
import pytest

from earshot.llm import url_filters as U
from earshot.llm.queries import ORACLE_SQL, QUERIES

PAGES = "page_id long, url string, html string, host string, rule string, node string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", "r", "n") for r in rows], PAGES)


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    return sorted(map(str, con.execute(U.ORACLE).fetchall()))


ODD = [
    (1, "http://a.org/x", '<link rel="canonical" href="http://b.net/y">'),
    (2, "https://b.net/y#z", None),
    (3, "http://c.org/q?x=1", '<META HTTP-EQUIV=refresh content="0; URL=../x">'),
    (4, "http://a.org/x", '<!-- <link rel=canonical href="http://d.net/"> -->'),
    (5, None, "x"),
    (None, "nothing", '<link rel=canonical href="/a">'),
    (7, "http://A.ORG", "<link href='/x/./y/../' rel=\"alternate canonical\">"),
    (8, "http://e.org/f/", "<link rel=canonical href=http://www.example.net/en/1>"),
    (9, "http://e.org/g", '<link rel=canonical href=f/><link rel=canonical href="//bad.net">'),
    (10, "http://h.org/g", '<link rel=canonical href="//bad.net/">'),
    (10, "http://h.org/g", ""),
    (11, "http://c.org/x", '<link rel=canonical href="/y?a=1&amp;b=2">'),
    (12, "http://c.org/y?a=1&b=2", "<meta http-equiv=\"refresh\" content=\"5;url='http://k.net/'\">"),
    (13, "http://m.org/", '<script><link rel=canonical href="http://k.net/"></script><link rel=canonical href="mailto:x@k.net">'),
    (14, "http://n.org/" + "a/" * 50_000 + "?x", "<link " * 5_000 + "canonical"),
    (15, "x://y://z.net/?q", ""),
]


def test_odd_pages(spark):
    got = U.judge(frame(spark, ODD), U.RULES).collect()
    assert sorted(str(tuple(r)) for r in got) == by_sql(ODD)
    verdict = {r.page_id: (r.rule, r.verdict) for r in got}
    assert verdict[1] == verdict[4] == (None, "block")  # aliases of b.net
    assert verdict[3] == verdict[11] == verdict[12] == (None, "block")  # a chain to k.net
    assert verdict[8] == verdict[9] == verdict[10] == (None, "allow")  # an alias is allowed by a rule
    assert verdict[2] == ("net/", "block") and verdict[13] == verdict[None] == (None, "allow")
    assert U.judge(frame(spark, []), U.RULES).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op11(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    got = QUERIES["op11_url_filters"](spark, d)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, con.execute(ORACLE_SQL["op11_url_filters"]).fetchall()))


def test_classes_by_union_find_and_a_hot_address(spark):
    """Chains, stars and a ring; a third of all pages link to one address, another third is one url."""
    rng = np.random.default_rng(4)
    urls = [f"http://s{i % 40}.{('com', 'org', 'net')[i % 3]}/{('en', 'fr', 'de')[i % 7 % 3]}/{i}" for i in range(240)]
    edges = [(i, i + 1) for i in range(0, 30)] + [(i, 40) for i in range(41, 80)] + [(90 + i, 90 + (i + 1) % 9) for i in range(9)] + [tuple(map(int, rng.integers(120, 240, 2))) for _ in range(50)]
    rows = [(k, urls[a], f'<html><link rel="canonical" href="{urls[b]}">') for k, (a, b) in enumerate(edges)]
    rows += [(1000 + i, urls[i], "") for i in range(240)] + [(2000 + i, urls[1], None) for i in range(500)]
    redirects = spark.createDataFrame([(urls[0], urls[60]), (None, urls[3]), (urls[5], "nowhere")], "source string, target string")
    root = list(range(240))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in [*edges, (0, 60)]:
        root[find(a)] = find(b)

    def ruled(i):
        host, path = urls[i].split("://")[1].split("/", 1)
        fits = [r for r in U.RULES if (host == r[1] or host.endswith("." + r[1])) and ("/" + path).startswith(r[2])]
        return max(fits, key=lambda r: len(r[1] + r[2]))[0] if fits else None

    of = {}
    for i in range(240):
        of.setdefault(find(i), set()).add(ruled(i))
    want = {urls[i]: ruled(i) or ("block" if of[find(i)] >= {"block"} and "allow" not in of[find(i)] else "allow") for i in range(240)}
    got = U.judge(frame(spark, rows), U.RULES, redirects).collect()
    assert len(got) == len(rows) and {(r.page_id, r.verdict) for r in got} == {(k, want[u]) for k, u, _ in rows}
    assert {want[u] for _, u, _ in rows if ruled(urls.index(u)) is None} == {"block", "allow"}
    # a list of rules too long for an expression gives the same
    more = [*U.RULES, *(("block", f"x{i}.example", "/") for i in range(U.MOST_INLINE))]
    assert {(r.page_id, r.rule, r.verdict) for r in U.judge(frame(spark, rows), more, redirects).collect()} == {(r.page_id, r.rule, r.verdict) for r in got}


def test_plain_python_runs_nowhere(spark):
    plan = QUERIES["op11_url_filters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
