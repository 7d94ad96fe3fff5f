from __future__ import annotations

import datetime as dt

from graphloom.llm import url_filter


def test_rules_hold_for_hosts_of_many_labels(spark):
    at = dt.datetime(2024, 5, 1)
    hosts = [".".join(["a"] * n) + ".bad.example" for n in (1, 125, 126, 200)]
    captures = spark.createDataFrame([(f"http://{h}/x", at) for h in hosts], "url string, fetched_at timestamp_ntz")
    rules = ["bad.example", hosts[-1]]
    entries = spark.createDataFrame([("block", "domain", p, "add", "spam", dt.datetime(2024, 1, 1)) for p in rules], "list string, kind string, pattern string, action string, category string, effective_at timestamp_ntz")
    got = {r.url: (r.n_active, r.rule, r.blocked) for r in url_filter.filter_urls(captures, entries).collect()}
    want = {f"http://{h}/x": (1, "bad.example", True) for h in hosts[:-1]}
    assert got == want | {f"http://{hosts[-1]}/x": (2, hosts[-1], True)}


def test_hosts_of_awkward_urls(spark):
    urls = {
        "http://[2001:db8::1]:80/x": "[2001:db8::1]", "http://[2001:DB8::2]": "[2001:db8::2]", "http://user@x@evil.com/": "evil.com", "http://user:p@evil.com:8080/a@b": "evil.com", "\thttp://evil.com/": "evil.com",
        "\x01 http://ev\til.com": "evil.com", "http:\\\\evil.com\\a": "evil.com", "//evil.com?x=http://other.com/": "evil.com", "evil.com#/x": "evil.com", "http://good.com\\@evil.com/": "good.com", "http:///": None, "": None, None: None, "http://Evil.com../x": "evil.com",
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.h for r in df.select("u", url_filter.host_of(df.u).alias("h")).collect()} == urls
    at = dt.datetime(2024, 5, 1)
    captures = spark.createDataFrame([(u, at, "own", False) for u in urls], "url string, fetched_at timestamp_ntz, category string, blocked boolean")
    entries = spark.createDataFrame([("block", "domain", p, "add", "spam", dt.datetime(2024, 1, 1)) for p in ("[2001:db8::1]", "evil.com")], "list string, kind string, pattern string, action string, category string, effective_at timestamp_ntz")
    out = url_filter.filter_urls(captures, entries)
    assert out.columns == ["url", "fetched_at", "category", "blocked", "n_active", "rule", "rule_list", "_category", "_blocked"]
    assert {r.url: r._blocked for r in out.collect()} == {u: h in ("evil.com", "[2001:db8::1]") for u, h in urls.items()}
