import random

import pytest
from pyspark.sql import functions as F

from arborform.llm.linkrank import UNIT, edges, host_scores, judge, settled


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_hosts_paths_and_rules(spark):
    rows = [(1, "http://A.Example.ORG/es/x?q#f", ""), (2, "https://example.org/en/12", None), (3, "http://example.org?x/es/", ""),
            (4, "HTTP://www.shop.com/fr/1#a", ""), (5, "http://shop.com/de/", ""), (6, "no scheme", ""), (7, None, None),
            (8, "x://y://z.org/", ""), (9, "http://notexample.org/es/", ""), (10, "http://org/", ""), (11, "://", ""), (12, "http://com/fr", "")]
    got = {r["page_id"]: (r["_host"], r["_path"], r["_rule"], r["_verdict"]) for r in judge(pages(spark, rows), "url", "html").collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3][:3] == ("example.org", "", None)
    assert got[4] == ("www.shop.com", "/fr/1", "com/fr/", "allow")
    assert got[5] == ("shop.com", "/de/", "com/de/", "block")
    assert got[6][:3] == got[7][:3] == got[11][:3] == ("", "", None)
    assert got[8][:2] == ("y:", "//z.org/")
    assert got[9][2:] == ("org/", "allow") and got[10][2:] == ("org/", "allow")
    assert got[12][2] is None
    assert got[6][3] == "allow"


def test_trust_and_distrust_reach_linked_hosts(spark):
    rows = [(1, "http://good.org/a", '<a href="http://friend.net/x">'), (2, "http://bad.com/de/1", "<a href='/self'>"),
            (3, "http://farm.net/", '<a HREF=http://bad.com/de/1 ><a href="//bad.com/z">'), (4, "http://friend.net/", ""),
            (5, "http://lonely.net/", None)]
    got = {r["page_id"]: r["_verdict"] for r in judge(pages(spark, rows), "url", "html").collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow"}


def brute(seeds, graph, damping=0.85, steps=300):
    """Plain power iteration; what hosts without edges hold goes back to the seeds."""
    outgoing, total, score = {s for s, _ in graph}, sum(seeds.values()), dict(seeds)
    for _ in range(steps):
        lost = sum(m for h, m in score.items() if h not in outgoing)
        new = {h: m * ((1 - damping) + damping * lost / total) for h, m in seeds.items()}
        for (s, d), share in graph.items():
            new[d] = new.get(d, 0) + damping * score.get(s, 0) * share
        score = new
    return score


def table(spark, seeds, graph):
    return (spark.createDataFrame([(k, h, int(m)) for k, own in seeds.items() for h, m in own.items()], "k int, host string, mass bigint"),
            spark.createDataFrame([(k, s, d, w) for k, own in graph.items() for (s, d), w in own.items()], "k int, src string, dst string, share double"))


@pytest.mark.parametrize("hub_edges, bucket_edges", [(1_000_000, 500_000), (1_000_000, 3), (1, 3)])
def test_rank_equals_plain_power_iteration(spark, hub_edges, bucket_edges):
    """In one partition, in buckets, and with a hub apart."""
    one = {("a", "b"): 0.5, ("a", "c"): 0.5, ("b", "a"): 1.0, ("c", "c"): 0.25, ("c", "d"): 0.75}
    graph = {0: one, 1: {(d, s): 1.0 for s, d in one if s != d and (s, d) != ("a", "b")} | {("c", "c"): 0.5, ("c", "a"): 0.5}}
    seeds = {0: {"a": 7e14, "d": 3e14}, 1: {"d": 1e15}}
    got = {(r["k"], r["host"]): r["score"] for r in settled(*table(spark, seeds, graph), hub_edges=hub_edges, bucket_edges=bucket_edges).collect()}
    for k in (0, 1):
        want = brute(seeds[k], graph[k])
        assert all(abs(got.get((k, h), 0) - m) < 1e-7 * UNIT for h, m in want.items()), k


def test_stopping_early_changes_no_verdict(spark):
    rnd = random.Random(6)
    for _ in range(3):
        hosts = [f"h{i}" for i in range(25)]
        graph = {}
        for k in (0, 1):
            graph[k] = {}
            for s in hosts:
                to = rnd.sample(hosts, rnd.randint(0, 3))
                graph[k].update({(s, d): 1 / len(to) for d in to})
        seeds = {k: {h: UNIT // 4 for h in rnd.sample(hosts, 4)} for k in (0, 1)}
        rows = settled(*table(spark, seeds, graph), threshold=1.0).collect()
        got = {(r["k"], r["host"]): r["score"] for r in rows}
        t, d = brute(seeds[0], graph[0]), brute(seeds[1], graph[1])
        for h in hosts:
            if abs(t.get(h, 0) - d.get(h, 0)) > 1e-6 * UNIT or not (t.get(h, 0) or d.get(h, 0)):
                assert (got.get((1, h), 0) > got.get((0, h), 0)) == (d.get(h, 0) > t.get(h, 0)), h


def test_edges_and_repeats_and_clashes(spark):
    df = pages(spark, [(1, "http://a.x.org/", '<a href="http://b.org/">1</a><a href="/in">')] * 2).withColumn("host", F.lit("clash")).withColumn("hit", F.lit(1))
    out = judge(df, "url", "html").collect()
    assert len(out) == 2 and out[0]["host"] == "clash" and out[0]["_host"] == "a.x.org"
    e = edges(spark.createDataFrame([("h", '<a href="http://B.org/">1</a><a href="/in"><a href="/in2">'), ("h", None)], "host string, html string"))
    assert {(r["src"], r["dst"], r["n"]) for r in e.collect()} == {("h", "b.org", 1), ("h", "h", 2)}


def test_empty_table(spark):
    assert judge(pages(spark, []), "url", "html").count() == 0
    assert host_scores(spark.createDataFrame([], "host string, verdict string, html string")).count() == 0


def test_distrust_reaches_hosts_more_than_twelve_links_away(spark):
    rows = [(0, "http://h0.com/de/", "")] + [(i, f"http://h{i}.com/x", f'<a href="http://h{i - 1}.com/">') for i in range(1, 21)]
    got = {r["page_id"]: r["_verdict"] for r in judge(pages(spark, rows), "url", "html").collect()}
    assert got == {i: "block" for i in range(21)}


def test_no_mass_is_lost_to_hosts_without_links(spark):
    graph = {0: {("a", "b"): 0.5, ("a", "c"): 0.5, ("c", "a"): 1.0}, 1: {}}
    seeds = {0: {"a": 7 * UNIT // 10, "d": 3 * UNIT // 10}, 1: {}}
    got = {r["host"]: r["score"] / UNIT for r in settled(*table(spark, seeds, graph)).collect()}
    want = brute(seeds[0], graph[0])
    assert all(abs(got[h] - want[h] / UNIT) < 1e-7 for h in want) and abs(sum(got.values()) - 1) < 1e-7


def test_a_very_long_page(spark):
    html = '<a href="/x">' * 100_000 + '<a href="http://bad.com/de/">'
    rows = [(1, "http://bad.com/de/1", ""), (2, "http://long.net/", html)]
    got = {r["page_id"]: r["_verdict"] for r in judge(pages(spark, rows), "url", "html").collect()}
    assert got == {1: "block", 2: "block"}


def test_sql_follows_a_long_chain(spark):
    """The query's SQL has to settle too: 21 hosts in a row, the first one blocked."""
    import duckdb
    import pandas as pd

    from arborform.llm.q_linkrank import SQL
    rows = [(0, "http://h0.com/de/", "")] + [(i, f"http://h{i}.com/x", f'<a href="http://h{i - 1}.com/">') for i in range(1, 21)]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    rel = con.sql(SQL)
    at = {c: i for i, c in enumerate(rel.columns)}
    assert {r[at["page_id"]]: r[at["verdict"]] for r in rel.fetchall()} == {i: "block" for i in range(21)}
