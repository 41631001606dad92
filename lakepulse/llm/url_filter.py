"""URL rules by a range join on reversed hosts, in DataFrame operations alone.

A host's labels in reverse order, each followed by a dot, make its key: ``blog.example.net`` is ``net.example.blog.``. The
hosts under a rule's host are then an interval of keys, from ``net.example.`` up to ``net.example/`` (the character behind the
dot), and the intervals of different rules are nested or apart.

Rule hosts and URLs are sorted by key together and swept once by a window. Its columns are the stack of open rules, one
for each depth (number of labels): the last rule host of that depth, which is still open if its interval's end is behind
the URL's key. Of the open rules those whose path begins the URL's path fit, and the longest wins.

URLs and rule hosts are dealt together to parts, by ranges of key and, within a key, of a hash of the row: a frequent host
spans several parts, and a rule host is in one. Each part is swept for itself. What is open at its first key are the rules of
that key's ancestors, which are joined by equality; so there are as many rule rows as rule hosts, and a few for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakepulse.session import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _host_and_path(rest: Column) -> tuple[Column, Column]:
    """Of a URL behind its scheme: the host up to ``/``, ``?`` or ``#``, then the path up to ``?`` or ``#``."""
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def with_host_and_path(pages: DataFrame) -> DataFrame:
    scheme = F.instr("url", "://")
    rest = F.when(scheme > 0, F.substring(F.col("url"), scheme + 3, F.length("url")))
    host, path = _host_and_path(F.coalesce(rest, F.lit("")))
    return pages.withColumns({"host": host, "path": path})


def rule_hosts(rules: DataFrame) -> DataFrame:
    """``key, end, depth, own``: a row for each host of ``rules`` (verdict, rule), with its rules."""
    host, path = _host_and_path(F.col("rule"))
    parsed = rules.where(F.length("rule") > 0).select(
        host_key(host).alias("key"),
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("/")).alias("end"),
        F.size(F.split(host, r"\.")).alias("depth"),
        F.struct("rule", path.alias("path"), "verdict").alias("own"),
    )
    return parsed.groupBy("key", "end", "depth").agg(F.collect_set("own").alias("own"))


def deal(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """URLs (``page``, of kind 1) and rule hosts (kind 0) with their ``key`` and ``part``, as many parts as shuffle partitions.

    The table is written, so that parts stay what they are. Rows of the same id and URL are in one part.
    """
    row = F.xxhash64(*[c for c in ("page_id", "url") if c in urls.columns])
    pages = urls.select(F.struct(*urls.columns).alias("page"), host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), row.alias("row"))
    both = pages.unionByName(hosts.withColumns({"kind": F.lit(0), "row": F.lit(0).cast("long")}), allowMissingColumns=True)
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartitionByRange(parts, "key", "kind", "row").withColumn("part", F.spark_partition_id())
    return written(dealt.drop("row"), "url-parts")


def open_before(dealt: DataFrame, hosts: DataFrame, depth: int) -> DataFrame:
    """The rule hosts that are open at the first key of a part, up to the given depth: those of its ancestors and its own."""
    first = dealt.groupBy("part").agg(F.min("key").alias("first"))
    labels = F.split("first", r"\.")
    lengths = F.sequence(F.lit(1), F.least(F.size(labels) - 1, F.lit(depth)))
    ancestors = F.transform(lengths, lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))
    return first.select("part", F.explode(ancestors).alias("key")).join(hosts, "key").withColumn("kind", F.lit(0))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` behind its columns; no row is dropped.

    ``rules`` has ``verdict`` and ``rule``, a host followed by a path that begins with ``/``. A rule fits its host and all
    subdomains if the URL's path begins with its path. The rule with the most characters wins; of equally long ones
    the one with the longer host, then the last by text, then by verdict. Without a rule the verdict is ``default``
    and the rule null. A null URL, or one without ``://``, has an empty host and path. Repeated rows are judged alike.
    Columns of ``pages`` with the added names are replaced. Rules without text are left out; rules of one host are held
    in one row, so a host should have thousands of them at most.
    """
    own = with_host_and_path(pages.drop("host", "path", "rule", "verdict"))
    names = own.columns
    hosts = written(rule_hosts(rules), "rule-hosts")
    depths = sorted(r["depth"] for r in hosts.select("depth").distinct().collect())  # a host has 127 labels at most
    both = deal(own, hosts)
    if depths:
        both = both.unionByName(open_before(both, hosts, depths[-1]), allowMissingColumns=True)
    # Sorted by ranges of parts, so that a task gets about as many as any other.
    both = both.repartitionByRange("part")
    swept = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = {
        f"open_{d}": F.last(F.when((F.col("kind") == 0) & (F.col("depth") == d), F.struct("end", "own")), ignorenulls=True).over(swept)
        for d in depths
    }
    found = both.select("page", "key", "kind", *[c.alias(n) for n, c in stack.items()]).where("kind = 1")
    nothing = F.expr("CAST(array() AS array<struct<rule: string, path: string, verdict: string>>)")
    open_rules = [F.when(F.col(n)["end"] > F.col("key"), F.col(n)["own"]).otherwise(nothing) for n in stack]
    candidates = F.concat(*open_rules) if open_rules else nothing
    fitting = F.filter(candidates, lambda r: F.startswith(F.col("page.path"), r["path"]))
    ranked = F.transform(
        fitting,
        lambda r: F.struct(
            F.length(r["rule"]).alias("length"),
            (-F.length(r["path"])).alias("host_length"),
            r["rule"].alias("rule"),
            r["verdict"].alias("verdict"),
        ),
    )
    best = F.array_max(ranked)
    judged = found.select("page.*", best.alias("__best"))
    return judged.select(
        *names, F.col("__best")["rule"].alias("rule"), F.coalesce(F.col("__best")["verdict"], F.lit(default)).alias("verdict")
    )


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    values = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(verdict, rule)")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
),
parsed AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parsed
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
