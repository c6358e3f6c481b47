"""URL verdicts: hosts, paths and rules against a plain reading, the method by held-out accuracy."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gritlens.llm import urlfilter
from gritlens.llm.queries import URL_RULES

SCHEMA = "page_id bigint, url string, html string, host string, rule int, features string, `a.b` int"


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "h", "x", 1, "f", 2) for i, u in enumerate(urls)], SCHEMA)


def read(url):
    """(host, path, rule, verdict of the rule) in the plain way."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", "", None, None
    host = re.split("[/?#]", url[at + 3 :], maxsplit=1)[0]
    path = re.split("[?#]", url[at + 3 + len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = (None, None)
    for verdict, rule in URL_RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return host, path, *best


URLS = [
    "https://Example.ORG/es/1", "http://a.example.org/en/1x", "http://a.example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/fr",
    "http://com/de/1", "x://org", "x://org/", "x://org?q=/", "x://org#/", "nothing", "", None, "://", ":///org/", "a://b://org/", "http://ÄB.Org/\n/x?y",
    "http://u@x.org:80/", "http://org./", "HTTP://X.COM/DE/", "http://x.com/de/" + "a" * 50_000, "http://é.com/de/?%20", "http://x.com//de/", "http://.org/es/",
    "http://x.example.org/es/?a=1&b=2#c", "http://x.example.org/es#", "http://x.org\t/1", "ftp://x.org", "http://com/fr/../de/",
]


def test_hosts_paths_and_rules(spark):
    found = urlfilter.judged(frame(spark, URLS), URL_RULES).orderBy("page_id").collect()
    assert len(found) == len(URLS)
    for url, row in zip(URLS, found):
        host, path, rule, verdict = read(url)
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule), url
        assert row["verdict"] == verdict if verdict else row["verdict"] in ("allow", "block"), url


def made(seed, n):
    """URLs of which long ones with many digits and parameters are bad."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        bad = rng.random() < 0.3
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(12, 30) if bad else rng.randint(0, 5)))
        query = "&".join(f"k{i}={rng.randint(0, 9)}" for i in range(rng.randint(3, 6) if bad else rng.randint(0, 2)))
        url = f"https://{rng.choice(['a', 'b', 'c'])}{rng.randint(0, 40)}.{rng.choice(['net', 'info'])}/{rng.choice(['x', 'y'])}/{digits}{'?' + query if query else ''}"
        rows.append((url, "block" if bad else "allow"))
    return rows


def test_the_method_learns(spark):
    rows = made(1, 3000)
    known = {u: v for u, v in rows[:1500]}
    table = spark.createDataFrame([(i, u, known.get(u)) for i, (u, _) in enumerate(rows)], "page_id bigint, url string, known string")
    found = {r["page_id"]: r for r in urlfilter.judged(table, [], label=F.col("known"), fit_rows=1000).collect()}
    held_out = [(found[i]["verdict"], v) for i, (u, v) in enumerate(rows) if u not in known]
    assert len(held_out) > 1000 and sum(a == b for a, b in held_out) > 0.97 * len(held_out)
    assert all(r["rule"] is None and 0 <= r["score"] <= 1 for r in found.values())


def test_one_kind_of_label(spark):
    urls = ["http://a.net/1", None, "http://b.net/"]
    for rules, verdict in (([], "allow"), ([("block", "org/")], "block"), ([("allow", "org/")], "allow")):
        found = urlfilter.judged(frame(spark, [*urls, "http://x.org/"]), rules).collect()
        assert {r["verdict"] for r in found if r["rule"] is None} == {verdict}
    assert urlfilter.judged(frame(spark, []), URL_RULES).count() == 0
    # of two rules with one text the block counts
    (row,) = urlfilter.judged(frame(spark, ["http://x.org/"]), [("allow", "org/"), ("block", "org/")]).collect()
    assert row["verdict"] == "block"


def test_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    urls = {r["page_id"]: r["url"] for r in table.collect()}
    found = urlfilter.judged(table, URL_RULES).collect()
    assert len(found) == len(urls)
    for r in found:
        host, path, rule, verdict = read(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and verdict in (None, r["verdict"])
    again = urlfilter.judged(table.repartition(7), URL_RULES).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in again) == sorted((r["page_id"], r["verdict"]) for r in found)


@pytest.mark.parametrize("text, name", [("http://x.org/a1", "digits"), ("http://x.org/?a&b", "parameters")])
def test_lexical_features(text, name):
    import pyarrow as pa

    from gritlens.llm.textbuf import Texts

    one = [Texts.of(pa.array([t])) for t in (text, "x.org", "/")]
    value = dict(zip(urlfilter.LEXICAL, urlfilter.lexical(*one)[0]))
    assert value[name] == {"digits": 1 / 15, "parameters": 2}[name]
    assert value["secure"] == 0 and value["host_length"] == 5 and value["host_parts"] == 1
