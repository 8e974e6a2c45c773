"""URL rules by a sort-merge range join over canonical keys.

A host's canonical key is its labels reversed, each with its dot (``www.example.com`` is
``com.example.www.``): a rule's host and all its subdomains are then the keys that begin
with the rule's, an interval of the sorted keys. Intervals of this kind are disjoint or
nested. ``sweep`` sorts keys and interval starts together and carries the interval begun last,
whose chain of enclosing intervals is the stack; those that end before a key are popped.

Two sweeps judge a url: one over hosts finds the rule hosts around each distinct host, one over
(rule host, path) finds the rule paths that begin each path. Both run over distinct keys, so a
host or url that a third of all rows share is swept once. Only DataFrame operations are used.

A key range belongs to one sorted partition; what is active at its lower end comes from a
table with one row a partition. Partition numbers are read only after they have been
written, as a range exchange that runs again may cut elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernlake.runtime import materialize

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: For urls that no rule fits.
DEFAULT_VERDICT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between a rule host's key and a path.
SEP = "\u0001"
PARTS = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def sweep(points: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``key, stack``: for each distinct ``points.key`` all ``prefixes.key`` that it begins with, longest first.

    Null keys are left out; keys without any prefix have an empty stack.
    """
    starts = prefixes.select("key").filter("key is not null").distinct()
    shorter = starts.select(F.col("key").alias("own"), F.explode(F.expr("transform(sequence(1, length(key)), n -> substring(key, 1, n))")).alias("key"))
    chains = (
        shorter.join(starts, "key")
        .groupBy("own")
        .agg(F.collect_set("key").alias("chain"))
        .select(F.col("own").alias("key"), F.lit(0).alias("kind"), F.expr("array_sort(chain, (a, b) -> length(b) - length(a))").alias("chain"))
    )
    rows = points.select("key").filter("key is not null").distinct().select("key", F.lit(1).alias("kind"), F.lit(None).cast("array<string>").alias("chain")).union(chains)
    cut, _ = materialize(rows.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "sweep")
    ends = cut.groupBy("part").agg(F.max_by("chain", F.when(F.col("kind") == 0, F.col("key"))).alias("ending"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", F.last("ending", ignorenulls=True).over(before).alias("carried"))
    sofar = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    begun = cut.withColumn("begun", F.last("chain", ignorenulls=True).over(sofar)).filter("kind = 1")
    return begun.join(F.broadcast(carried), "part").select("key", F.expr("filter(coalesce(begun, carried, array()), p -> startswith(key, p))").alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row; ``rules`` has ``host, path, verdict``.

    Null urls and those without ``://`` have empty host and path. The rule with the longest
    host and path wins, on equal length the one with the longer host; of a rule given twice with
    different verdicts, ``block``. Rows without a rule have the default verdict. Repeated rows stay.
    """
    given = (
        rules.select(F.translate("host", UPPER, LOWER).alias("rhost"), F.col("path").alias("rpath"), "verdict")
        .filter("rhost is not null and rpath is not null")
        .groupBy("rhost", "rpath")
        .agg(F.max("verdict").alias("verdict"))
        .select(host_key(F.col("rhost")).alias("node"), "rpath", F.concat("rhost", "rpath").alias("rule"), "verdict")
        .withColumn("prefix", F.concat("node", F.lit(SEP), "rpath"))
    )
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    hosts = sweep(parsed.select("host").distinct().select(host_key(F.col("host")).alias("key")), given.select(F.col("node").alias("key")))
    around = hosts.select(F.col("key").alias("hkey"), F.explode("stack").alias("node"))
    urls = parsed.select(host_key(F.col("host")).alias("hkey"), "host", "path").distinct()
    asked, _ = materialize(urls.join(around, "hkey").select("host", "path", "node", F.concat("node", F.lit(SEP), "path").alias("key")), "asked")
    fits = sweep(asked.select("key"), given.select(F.col("prefix").alias("key"))).select("key", F.get("stack", F.lit(0)).alias("prefix")).filter("prefix is not null")
    best = (
        asked.join(fits, "key")
        .join(given.select("prefix", "rule", "verdict"), "prefix")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.length("node").alias("h"), "rule", "verdict")).alias("best"))
    )
    return parsed.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlake.runtime import table

    fixed = F.array(*(F.struct(F.lit(host).alias("host"), F.lit(path).alias("path"), F.lit(verdict).alias("verdict")) for host, path, verdict in RULES))
    return judge(table(spark, sf_dir, "pages"), spark.range(1).select(F.inline(fixed)))


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}'))"


_LONGEST = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
SQL = f"""
with parsed as (
  select page_id,
         translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), '{UPPER}', '{LOWER}') as host,
         coalesce(regexp_extract(url, '{PARTS}', 2), '') as path
  from pages)
select page_id, host, path,
       case {" ".join(f"when {_fits(h, p)} then '{h}{p}'" for h, p, _ in _LONGEST)} end as rule,
       case {" ".join(f"when {_fits(h, p)} then '{v}'" for h, p, v in _LONGEST)} else '{DEFAULT_VERDICT}' end as verdict
from parsed
"""
