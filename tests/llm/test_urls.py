import re

import duckdb
import pytest

from lakepulse.llm.url_filter import OP7_SQL, RULES, deal, filter_urls, op7_url_filter, open_before, rule_hosts, with_host_and_path

URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "https://NET/x", "http://a.net/en/1", "http://example.net/en/",
    "http://example.net/en", "http://x.Example.NET/en/?q", "http://notexample.net/en/", "http://example.net?x=/en/", "http://a.example.com/de/#t",
    "http://example.com/DE/", "http://example.com/de", "ftp://y.z.org/fr/1?a#b", "http://org/fr/", "http://org.net.com/", "http://a..net/x",
    "http://example.net:80/en/", "x://y://z.net/", "http://net./", "http://example.netx/en/", "://net/a", "http://b.a.net/p/q/r",
    "http://a.net/p/q", "http://c.b.a.net/p/", "http://a.net/p/" + "x" * 5000,
]
NESTED = [*RULES, ("allow", "a.net/"), ("block", "b.a.net/p/"), ("block", "a.net/p/q/r"), ("allow", "net/p/"), ("block", "c.b.a.net/")]


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for verdict, rule in rules:
        of, slash, rest = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith(slash + rest):
            fits.append((len(rule), -len(slash + rest), rule, verdict))
    _, _, rule, verdict = max(fits, default=(0, 0, None, "allow"))
    return host, path, rule, verdict


def pages(spark, urls):
    rows = [(None if i % 7 == 3 else i % 20, u, "x", "y") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, key string").repartition(3)


def table(spark, rules):
    return spark.createDataFrame(rules, "verdict string, rule string")


@pytest.mark.parametrize("rules", [RULES, NESTED, NESTED[:1], [*NESTED, *NESTED]])
def test_equals_brute_force(spark, rules):
    got = filter_urls(pages(spark, URLS * 3), table(spark, rules))
    rows = [(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted([(u, *judged(u, rules)) for u in URLS * 3], key=repr)


def test_hot_host_and_many_rules(spark):
    hot = [f"http://h.hot.net/p{i}/q" for i in range(3000)]
    cold = [f"http://s{i}.d{i % 40}.com/x" for i in range(1500)]
    rules = [("block", f"d{i}.com/") for i in range(40)] + [("allow", "s7.d7.com/x"), ("block", "net/"), ("allow", "hot.net/p7/"), ("block", "h.hot.net/p8")]
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages(spark, hot + cold), table(spark, rules)).collect()}
    assert got == {u: judged(u, rules) for u in hot + cold}


def test_rule_rows_grow_with_rules_and_parts_not_with_their_product(spark):
    urls = with_host_and_path(pages(spark, [f"http://h.hot.net/p{i}" for i in range(2000)] + [f"http://s.d{i}.com/" for i in range(500)]))
    hosts = rule_hosts(table(spark, [("block", f"d{i}.com/") for i in range(500)] + [("block", "net/"), ("allow", "hot.net/")]))
    dealt = deal(urls, hosts)
    assert dealt.where("kind = 0").count() == hosts.count() == 502
    assert dealt.where("page.host = 'h.hot.net'").select("part").distinct().count() > 1
    opened = open_before(dealt, hosts, 2)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 0 < opened.count() <= 2 * parts


def test_no_rules_and_no_pages(spark):
    got = filter_urls(pages(spark, URLS), table(spark, []), default="block")
    assert got.where("rule IS NULL AND verdict = 'block'").count() == len(URLS)
    assert filter_urls(pages(spark, []), table(spark, RULES)).count() == 0


def test_no_python_and_no_pair_of_tables(spark, tiny):
    plan = op7_url_filter(spark, tiny)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_equals_sql(spark, tiny):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tiny}/pages.parquet'")
    expected = duckdb.sql(OP7_SQL).fetchall()
    assert sorted(expected) == sorted(tuple(r) for r in op7_url_filter(spark, tiny).collect())
