"""URL filter: a sort-merge range join of URLs with host and path rules.

A host becomes a key of its labels in reverse ("a.example.com" -> "com,example,a,"). A rule's host and its subdomains then
are the interval of keys that start with the rule's key, and such intervals nest or are disjoint. Rules and URLs are sorted
together; each rule row carries the stack of rules whose intervals are open at its key (its ancestors and itself), and the
sweep takes the last stack before each URL. A rule on the stack whose interval has ended meanwhile fails the prefix test, and
every rule whose interval is still open is on the last stack: a rule between an open rule's key and the URL's starts with
that key. Of the stack's rules whose path starts the URL's path, the longest wins.

The sweep is cut by the first label and by a salt of the page's id, and rules are copied to each salt, so a host with a third
of all pages is swept in many parts. Only DataFrame functions are used.

A null URL, or one without "://", has an empty host and path and fits no rule. Equal rules count once; of rules that differ in
their action only, block wins. Extra columns are ignored; no pages give no rows, no rules give every page the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SALTS = 64


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(","))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, action) pairs such as ("com/en/", "block") as (host, path, action, rule)."""
    made = spark.createDataFrame(rules, "rule string, action string")
    host = F.regexp_extract("rule", "^[^/]*", 0)
    return made.select(lower_ascii(host).alias("host"), F.expr("substring(rule, length(regexp_extract(rule, '^[^/]*', 0)) + 1)").alias("path"), "action", "rule")


def stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): for each host with rules, the rules of it and of the hosts that it is a subdomain of."""
    once = rules.groupBy("host", "path").agg(F.max_by(F.struct("action", "rule"), F.struct(F.col("action") == "block", "rule")).alias("r"))
    own = once.select(reversed_key(F.col("host")).alias("key"), F.struct(F.length("r.rule").alias("length"), F.length("host").alias("host_length"), reversed_key(F.col("host")).alias("key"), "path", "r.action", "r.rule").alias("entry"))
    labels = F.split(F.col("key"), ",")
    above = own.select("key").distinct().withColumn("up", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), ","), F.lit(",")))))
    return above.join(own.withColumnRenamed("key", "up"), "up").groupBy("key").agg(F.sort_array(F.collect_set("entry"), asc=False).alias("stack"))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", salts: int = SALTS) -> DataFrame:
    """(id, host, path, rule, verdict) of every page; rules: host, path, action, rule."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    first = F.substring_index("key", ",", 1)
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("key", reversed_key(F.col("host")))
    urls = urls.select(first.alias("label"), F.pmod(F.xxhash64(id_col, "host", "path"), F.lit(salts)).cast("int").alias("salt"), "key", F.lit(1).alias("kind"), id_col, "host", "path")
    starts = stacks(rules).select(first.alias("label"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", F.lit(0).alias("kind"), "stack")
    sweep = Window.partitionBy("label", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = urls.unionByName(starts, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    return both.withColumn("hit", F.when(F.col("host") != "", F.try_element_at(F.filter("stack", lambda r: F.col("key").startswith(r["key"]) & F.col("path").startswith(r["path"])), F.lit(1)))).select(id_col, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit(default)).alias("verdict"))
