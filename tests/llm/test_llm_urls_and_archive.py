import time

import pytest
from pyspark.sql import functions as F

from reachline.llm.url_filters import RULE_SCHEMA, judge_urls
from reachline.llm.warc import read_archive, write_archive
from reachline.session import new_work_path

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "", "block"),
         ("example.net", "/en/x/", "block"), ("example.net", "/en/x/", "allow"),
         ("org", "/fr/", "allow"), ("h.org", "/", "block"), (None, "/", "block")]
URLS = [None, "", "net/", "http://net/", "http://NET", "https://a.net/x?y", "http://xnet/",
        "http://example.net/en/", "http://b.example.net/en/x/1", "http://a.example.net/en/x/1#t",
        "http://a.example.net", "ftp://b.a.example.net?q", "http://x.org/fr/1", "http://x.org/de",
        "http://h.org/fr/", "http://h.org:80/fr/", "HTTP://W.h.Org/a", "http://é.org/fr/é",
        "http://h.org/", "http://h.org/", "no://://x", "http:///fr/"]


def judged(url):
    after = (url or "").partition("://")
    host = path = ""
    if after[1]:
        rest = after[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in RULES if h is not None
            and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (url, host, path, best and best[2], best[3] if best else "allow")


@pytest.mark.parametrize("partitions", [1, 5])
def test_rules_nest_and_the_longest_wins(spark, partitions):
    pages = spark.createDataFrame([(u, "mine", "x") for u in URLS],
                                  "url string, rule string, host string")
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    found = judge_urls(pages.repartition(partitions), rules)
    rows = [tuple(r) for r in found.select("url", "host", "path", "rule", "verdict").collect()]
    assert sorted(rows, key=repr) == sorted(map(judged, URLS), key=repr)


def test_empty_rules_and_pages(spark):
    pages = spark.createDataFrame([("http://a.net/",)], "url string")
    none = spark.createDataFrame([], RULE_SCHEMA)
    assert [r.verdict for r in judge_urls(pages, none, "block").collect()] == ["block"]
    assert judge_urls(pages.where("false"), spark.createDataFrame(RULES, RULE_SCHEMA)).count() == 0


def test_hosts_of_very_many_labels(spark):
    """Only domains no deeper than a rule's host are built."""
    begun = time.perf_counter()
    long = "a." * 20_000
    urls = [f"http://{long}example.net/en/x", f"http://{long}net", f"http://{long}", "http://.net/"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    found = judge_urls(pages, spark.createDataFrame(RULES, RULE_SCHEMA))
    rows = [tuple(r) for r in found.select("url", "host", "path", "rule", "verdict").collect()]
    assert sorted(rows, key=repr) == sorted(map(judged, urls), key=repr)
    assert time.perf_counter() - begun < 60


def test_depth_comes_from_stored_rules(spark):
    """The deepest rule decides how many labels of a host are looked up."""
    path = new_work_path(spark, "rules")
    rules = [("a", "", "block"), ("c.b.a", "/x", "allow"), ("d.c.b.a", "/", "block"),
             ("z.d.c.b.a", "/x", "allow")]
    urls = ["http://z.d.c.b.a/x", "http://d.c.b.a/", "http://c.b.a/x", "http://a", "http://b/x"]
    wanted = [[None] * 5, ["a", "a", "a", "a", None], ["c.b.a/x", "a", "c.b.a/x", "a", None],
              ["d.c.b.a/", "d.c.b.a/", "c.b.a/x", "a", None],
              ["z.d.c.b.a/x", "d.c.b.a/", "c.b.a/x", "a", None]]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    for first, best in enumerate(wanted):
        spark.createDataFrame(rules[:first], RULE_SCHEMA).write.mode("overwrite").parquet(path)
        found = {r.url: r.rule for r in judge_urls(pages, spark.read.parquet(path)).collect()}
        assert [found[u] for u in urls] == best


def test_rules_that_no_url_can_have_fit_none(spark):
    """Their keys must not run into those of other hosts."""
    rules = [("net", "x", "block"), ("x.net", "/foo", "allow"), ("org", "", "allow"),
             ("/p.org", "", "block"), ("o?.org", "/", "block"), ("NET", "", "block")]
    wanted = {"http://x.net/": None, "http://net/x": None, "http://x.net/foo": "x.net/foo",
              "http://org/p.html": "org", "http://o?.org/": None, "http://NET/": None}
    found = judge_urls(spark.createDataFrame([(u,) for u in wanted], "url string"),
                       spark.createDataFrame(rules, RULE_SCHEMA)).collect()
    assert {r.url: r.rule for r in found} == wanted


def test_url_plan_stays_native(spark):
    pages = spark.createDataFrame([("http://a.net/",)], "url string")
    plan = judge_urls(pages, spark.createDataFrame(RULES, RULE_SCHEMA))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text


PAGES = [(1, "http://a/", "x" * 1000), (2, "http://b/\r\nEvil: 1", "x" * 1000), (3, None, "short"),
         (4, "http://d/", "short"), (5, "http://e/", None), (6, "http://f/", "é" * 700),
         (7, "http://g/", "x" * 1000), (7, "http://g/", "x" * 1000), (None, "http://n/", "x" * 1000)]


def test_archive_round_trip(spark):
    path = new_work_path(spark, "archive")
    pages = spark.createDataFrame([(*p, "s") for p in PAGES],
                                  "page_id bigint, url string, html string, sha256 string")
    write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    rows = read_archive(spark, path).collect()
    wanted = []
    for key, url, html in PAGES:
        again = len(html or "") >= 700 and html[0] == "x" and key != 7
        wanted.append((key, (html or "").encode(), "revisit" if again else "response",
                       7 if again else None))
    assert sorted([(r.page_id, bytes(r.payload), r.record_type, r.refers_to) for r in rows],
                  key=repr) == sorted(wanted, key=repr)
    for r in rows:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        size = int(head.rsplit(b"Content-Length: ", 1)[1])
        assert rest[size:] == b"\r\n\r\n"
        if r.record_type == "response":
            assert rest[:size].endswith(bytes(r.payload))
        assert b"\r\nEvil" not in head


def test_a_damaged_payload_is_found(spark):
    path = new_work_path(spark, "archive")
    write_archive(spark.createDataFrame(PAGES[:2], "page_id bigint, url string, html string"), path)
    broken = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"y"))
    broken.write.mode("append").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        read_archive(spark, path).collect()


def test_empty_archive(spark):
    path = new_work_path(spark, "archive")
    write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert read_archive(spark, path).count() == 0
