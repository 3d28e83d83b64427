import time

from pyspark.sql import functions as F

from ordina.llm.url_filter import DAMPING, RESIDUAL, domain_links, host_and_path, host_links, judge_urls, propagate, rounds_for


def judged(spark, rows):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string").withColumn("trust", F.lit(9))
    return {r.page_id: r for r in judge_urls(df).collect()}


def test_hosts_and_paths(spark):
    urls = ["HTTP://WWW.Ex.ORG/A/b?x#y", "http://h", "http://h?q=/a", "h/a", None, "", "x://u@h:80/p#f", "a://b://c/d", "https://É.org/é"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    h, p = host_and_path(F.col("url"))
    got = [tuple(r) for r in df.select(F.coalesce(h, F.lit("")), F.coalesce(p, F.lit(""))).collect()]
    assert got == [("www.ex.org", "/A/b"), ("h", ""), ("h", ""), ("", ""), ("", ""), ("", ""), ("u@h:80", "/p"), ("b:", "//c/d"), ("É.org", "/é")]


def test_longest_rule_wins(spark):
    rows = [("http://a.example.net/en/1", None), ("http://a.example.net/de/1", None), ("http://notexample.net/en/", None), ("http://example.com/de/x", None), ("http://net", None), ("http://net/", None), ("http://x.org/fr/", None), ("http://x.org/fr", None), (None, "x"), ("nothing", "")]
    got = judged(spark, rows)
    assert [got[i].rule for i in range(len(rows))] == ["example.net/en/", "net/", "net/", "example.com/de/", None, "net/", "org/fr/", None, None, None]
    assert [got[i].verdict for i in (0, 1, 2, 3, 5, 6, 8, 9)] == ["allow", "block", "block", "block", "block", "allow", "allow", "allow"]
    assert (got[8].host, got[8].path) == ("", "")


def test_trust_and_distrust_travel(spark):
    link = lambda *hosts: "".join(f"<a class=x href='https://{h}/z'>t</a>" for h in hosts)
    rows = [("http://good.org/fr/1", link("friend.com")), ("http://bad.net/x", link("elsewhere.com")), ("http://farm.com/1", link("bad.net", "FARM.com")), ("http://friend.com/1", link("bad.net") + "<a href=/local>"), ("http://elsewhere.com/1", None)]
    got = judged(spark, rows)
    assert [got[i].verdict for i in range(5)] == ["allow", "block", "block", "allow", "allow"]
    assert got[3].trust > 0


def test_verdicts_flip_over_two_hops(spark):
    """No rule fits the hosts in between: what links to a host that links to a blocked one is blocked by more than it is trusted."""
    link = lambda *hosts: "".join(f"<a href='https://{h}/z'>t</a>" for h in hosts)
    blocked = [(f"http://b{i}.net/x", None) for i in range(8)]
    rows = [("http://far.com/1", link("near.com")), ("http://near.com/1", link(*(f"b{i}.net" for i in range(8))))] + blocked
    far = {r.host: r for r in judge_urls(spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string"), benefit=0.5).collect()}
    assert far["near.com"].distrust > 8 * DAMPING - 0.1 and far["near.com"].verdict == "block"
    assert far["far.com"].distrust > 8 * DAMPING**2 - 0.1 and far["far.com"].verdict == "block"
    alone = judged(spark, rows[:1] + [("http://near.com/1", None)] + blocked)
    assert alone[0].verdict == alone[1].verdict == "allow"


def test_rules_seed_hosts(spark):
    rows = [("http://a.net/en/1", None)] * 9 + [("http://x.example.net/en/1", None)] * 9 + [("http://c.example.com/de/1", None)] * 3 + [("http://c.example.com/en/1", None)] + [("http://d.example.com/de/1", None)] + [("http://d.example.com/en/1", None)] * 9 + [(f"http://e{i}.example.com/en/1", None) for i in range(8)]
    got = {r.host: r for r in judged(spark, rows).values() if r.rule is None or r.host.endswith("net")}
    assert got["a.net"].trust == 0 and got["x.example.net"].trust == 0  # the rule for all of net judges them, whatever most pages are
    assert got["c.example.com"].verdict == "block" and got["d.example.com"].verdict == "allow"
    assert got["d.example.com"].distrust > 0.1  # its own tenth, and some from c over example.com


def test_links_of_all_kinds(spark):
    html = "<BASE href='//base.com/'><a title=x href=http://A.com:80/x><area href=\"https://b.com?q\"><link rel=x href=//c.com><iframe src='http://d.com#'></iframe><a href='/own'><a href='page.html'><img src=http://no.com><a href='mailto:x@y'><abbr href=//no.com><a name=x>//no.com</a>"
    df = spark.createDataFrame([("own.com", html), ("own.com", html), ("", html), ("x.com", None), ("a.com:80", "<a href=//a.com:80/>")], "host string, html string")
    assert sorted(map(tuple, host_links(df, "host", "html").collect())) == [("own.com", x) for x in ("a.com:80", "b.com", "base.com", "c.com", "d.com")]


def test_domains(spark):
    hosts = ["a.b.c.com", "c.com", "com", "x.c.com", "1.2.3.4", "h:80", "u@a.b.com", "", "..com", "a.b.c.com", "y." * 200 + "com"]
    got = domain_links(spark.createDataFrame([(h,) for h in hosts], "host string"))
    assert sorted(map(tuple, got.collect())) == [("a.b.c.com", "b.c.com"), ("b.c.com", "c.com"), ("x.c.com", "c.com")]


def test_broken_links_take_linear_time(spark):
    begun = time.perf_counter()
    df = spark.createDataFrame([("h", part * 100_000) for part in ("<a ", "<a href=", "<a href='", "<a\t href href")], "host string, html string")
    assert host_links(df, "host", "html").isEmpty() and time.perf_counter() - begun < 30


def test_scores_equal_plain_iteration(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "a"), ("c", "e")]
    both = [("k", *e) for e in edges] + [("l", d, s) for s, d in edges]
    seeds = [("k", "a", 0.5), ("k", "d", 2.0), ("l", "e", 1.0)]
    got = {(r.kind, r.host): r.score for r in propagate(spark.createDataFrame(both, "kind string, src string, dst string"), spark.createDataFrame(seeds, "kind string, host string, mass double")).collect()}
    now = total = {(k, h): m for k, h, m in seeds}
    for _ in range(200):  # far beyond the residual
        then = {}
        for k, s, d in both:
            then[k, d] = then.get((k, d), 0) + DAMPING * now.get((k, s), 0) / sum(x[:2] == (k, s) for x in both)
        now, total = then, {h: total.get(h, 0) + then.get(h, 0) for h in {*total, *then}}
    assert {h for h, x in total.items() if x > 1e-9} <= got.keys()
    assert sum(abs(total[h] - got.get(h, 0)) for h in total) <= RESIDUAL * 3.5
    assert DAMPING ** (rounds_for() + 1) / (1 - DAMPING) <= RESIDUAL < DAMPING ** rounds_for() / (1 - DAMPING)


def test_empty_table(spark):
    assert judged(spark, []) == {}
