import datetime as dt
import random

import pytest

from strandloom.llm import url_filter

DAY0 = dt.date(2023, 11, 20)
SCHEMA = "page_id bigint, url string, fetched date, matched string"
LIST = "kind string, pattern string, action string, at date"


def covers(kind, pattern, url):
    rest = url.split("://", 1)[1]
    host, _, path = rest.partition("/")
    host = host.lower().rstrip(".")
    if kind == "domain":
        return host == pattern or host.endswith("." + pattern)
    steps = [s for s in path.split("?")[0].split("#")[0].split("/") if s]
    return pattern in {"/".join([host, *steps[:i]]) for i in range(len(steps) + 1)}


def brute(captures, entries):
    out = []
    for page_id, url, at, _ in captures:
        hits = set()
        if url and at:
            for kind, pattern in {(e[0], e[1]) for e in entries if e[0] and e[1]}:
                past = sorted((e[3], e[2]) for e in entries if e[:2] == (kind, pattern) and e[3] and e[3] <= at and e[2] in ("add", "remove"))
                if past and past[-1][1] == "add" and covers(kind, pattern, url):
                    hits.add(f"{kind}:{pattern}")
        out.append((page_id, url, at, len(hits), min(hits, default=None), bool(hits)))
    return out


@pytest.mark.parametrize("bucket", [32, 3])
def test_matches_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(url_filter, "BUCKET", bucket)
    r = random.Random(7)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "B.org"]
    day = lambda: DAY0 + dt.timedelta(r.randrange(120))
    captures = [(i, f"https://{r.choice(hosts)}/{r.choice(['', 'p', 'p/q', 'p/q/r?x=1', 'q#f'])}", day(), "old") for i in range(300)]
    captures += [(999, None, day(), "old"), (998, "https://a.com/", None, "old")] + [captures[0]] * 3
    entries = [(r.choice(["domain", "prefix"]), r.choice(["a.com", "x.a.com", "b.org", "a.com/p", "a.com/p/q", "b.org/q"]), r.choice(["add", "remove", "add", "odd"]), day()) for _ in range(120)]
    entries += [(None, "a.com", "add", DAY0), ("domain", "a.com", "add", None)]
    got = [tuple(x) for x in url_filter.filter_urls(spark.createDataFrame(captures, SCHEMA), spark.createDataFrame(entries, LIST)).select("page_id", "url", "fetched", "n_matches", "matched", "blocked").collect()]
    key = lambda t: str(t)
    assert sorted(got, key=key) == sorted(brute(captures, entries), key=key)


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.b/", DAY0, "o")], SCHEMA)
    entries = spark.createDataFrame([("domain", "a.b", "add", DAY0)], LIST)
    assert [r.blocked for r in url_filter.filter_urls(captures, entries.limit(0)).collect()] == [False]
    assert url_filter.filter_urls(captures.limit(0), entries).count() == 0
    assert [r.blocked for r in url_filter.filter_urls(captures, entries).collect()] == [True]


def blocked(spark, urls, entries):
    captures = spark.createDataFrame([(i, u, DAY0 + dt.timedelta(9), "") for i, u in enumerate(urls)], SCHEMA)
    rows = url_filter.filter_urls(captures, spark.createDataFrame([(k, p, "add", DAY0) for k, p in entries], LIST)).collect()
    return [r.blocked for r in sorted(rows, key=lambda r: r.page_id)]


def test_patterns_of_any_depth(spark):
    steps = [f"s{i}" for i in range(14)]
    deep = "a.com/" + "/".join(steps[:12])
    urls = [f"https://a.com/{'/'.join(steps)}?x", f"https://a.com/{'/'.join(steps[:12])}", f"https://a.com/{'/'.join(steps[:11])}", "https://a.com/" + "z/" * 20_000]
    assert blocked(spark, urls, [("prefix", deep)]) == [True, True, False, False]
    host = ".".join(steps) + ".org"
    assert blocked(spark, [f"http://x.{host}/", f"http://{host}", "http://" + "y." * 5000 + "org/"], [("domain", host)]) == [True, True, False]


def test_case_and_root_dot(spark):
    urls = ["http://A.com./P//q", "http://a.com/p/q", "http://a.com.:80/P/q?r"]
    assert blocked(spark, urls, [("domain", "A.COM.")]) == [True, True, True]
    assert blocked(spark, urls, [("prefix", "A.com/P/q/")]) == [True, False, True]
    assert blocked(spark, urls, [("prefix", "/p"), ("domain", "."), ("host", "a.com")]) == [False, False, False]


def test_timestamps_within_a_day(spark):
    at = lambda h, m=0: dt.datetime(2024, 3, 1, h, m)
    captures = spark.createDataFrame([(h, "http://a.com/", at(h)) for h in (1, 3, 4, 6, 8)], "page_id bigint, url string, fetched timestamp")
    entries = spark.createDataFrame([("domain", "a.com", "add", at(3)), ("domain", "a.com", "remove", at(5, 30)), ("domain", "a.com", "add", at(8))], LIST.replace("date", "timestamp"))
    rows = url_filter.filter_urls(captures, entries).collect()
    assert {r.page_id for r in rows if r.blocked} == {3, 4, 8}


def test_addresses_and_ports(spark):
    urls = ["http://[2001:db8::1]/x", "http://[2001:DB8::1]:8080/y?z", "http://u@[2001:db8::2]/x", "http://[::ffff:1.2.3.4]/", "http://1.2.3.4:80/p"]
    assert blocked(spark, urls, [("domain", "[2001:db8::1]")]) == [True, True, False, False, False]
    assert blocked(spark, urls, [("prefix", "[2001:db8::1]:443/x"), ("domain", "4]")]) == [True, False, False, False, False]
    assert blocked(spark, urls, [("domain", "1.2.3.4:8080")]) == [False, False, False, False, True]


def test_columns_of_any_type(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "http://a.com/", DAY0), (1, "http://a.com/", DAY0), (2, None, DAY0), (3, "http://b.com/", None)], "page_id bigint, url string, fetched date")
    rows = rows.withColumns({"headers": F.create_map(F.lit("k"), F.col("page_id")), "at": F.lit(7), "kind": F.lit("x"), "row_url": F.array(F.lit(None))})
    out = url_filter.filter_urls(rows, spark.createDataFrame([("domain", "a.com", "add", DAY0)], LIST))
    assert out.columns == [*rows.columns, "n_matches", "matched", "blocked"]
    assert sorted((r.page_id, r.headers["k"], r.blocked) for r in out.collect()) == [(1, 1, True), (1, 1, True), (2, 2, False), (3, 3, False)]
