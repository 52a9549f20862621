"""URL rules by a sort-merge range join over reversed-host keys.

A rule (host, path) fits its host and all subdomains if the url's path starts with its path. The key
of a rule is its host's labels in reverse, a zero byte and its path; what a rule fits on one host
is the interval of keys that begin with it, so rules on a host are nested or disjoint. A url becomes
one point per suffix of its host. Points and interval borders are sorted together and swept: at a
border the innermost open rule changes, and each point takes the one open where it lies. Each border
carries the rule that is on top of the stack after it, found from the rules alone: at its start
the rule itself, at its end the longest rule that encloses it. The longest rule over all suffixes wins.

Everything is DataFrame functions. Urls are reduced to distinct (host, path) pairs before they are
sorted, points on hosts without rules are dropped, and each host's points are dealt over ``salts``
sweeps, to which its borders are copied, so that no host's points meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textgrove.workspace import Workspace, broadcast_if_bounded, shuffle_tasks

TOP = b"\xff"  # above every byte of UTF-8 text


def host_and_path(url):
    """Columns host (A-Z lower-cased) and path of a url column; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    empty = F.lit("")
    return F.coalesce(F.translate(host, upper, lower), empty), F.coalesce(path, empty)


def _reversed(host):
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _borders(rules: DataFrame) -> DataFrame:
    """``suffix, key, rule``: at ``key`` the innermost open rule of host ``suffix`` becomes ``rule``.

    ``rule`` is a struct (length, host_length, verdict, rule) or null.
    """
    named = rules.select(
        F.lower("host").alias("suffix"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.lower("verdict").alias("verdict"),
    ).filter("suffix IS NOT NULL AND verdict IS NOT NULL")
    # of equal rules, block wins
    named = named.groupBy("suffix", "path").agg(F.max("verdict").alias("verdict"))
    text = F.concat("suffix", "path")
    rule = F.struct(
        F.length(text).alias("length"), F.length("suffix").alias("host_length"), "verdict", text.alias("rule")
    )
    key = F.concat(_reversed(F.col("suffix")), F.lit("\x00"), F.col("path")).cast("binary")
    named = named.select("suffix", "path", rule.alias("rule"), key.alias("key"))
    inner = named.select("suffix", "path", F.explode(F.expr("sequence(0, length(path))")).alias("n"))
    inner = inner.filter("n < length(path)").select(
        "suffix", F.col("path").alias("inner_path"), F.expr("substring(path, 1, n)").alias("path")
    )
    enclosing = inner.join(named.select("suffix", "path", "rule"), ["suffix", "path"])
    enclosing = enclosing.groupBy("suffix", F.col("inner_path").alias("path")).agg(F.max("rule").alias("outer"))
    ends = named.join(enclosing, ["suffix", "path"], "left")
    ends = ends.select("suffix", F.concat("key", F.lit(TOP)).alias("key"), F.col("outer").alias("rule"))
    return named.select("suffix", "key", "rule").unionByName(ends)


def judge(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    salts: int | None = None,
) -> DataFrame:
    """``page_id, host, path, rule, verdict``, one row per row of ``pages``.

    ``rules`` has host, path (null: empty) and verdict (allow or block). The longest fitting rule wins,
    of equally long ones that with the longer host. A page that no rule fits gets a null rule
    and the verdict ``default``; so do null urls and urls without ``://``, whose host and path are
    empty. Rules without host or verdict are ignored, of repeated rules block wins. Repeated pages
    stay; an empty table gives no rows.
    """
    spark = pages.sparkSession
    work = Workspace(spark)
    salts = salts or shuffle_tasks(spark)
    host, path = host_and_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    borders = work.write(_borders(rules), "borders")
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size("labels")),
        lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."),
    )
    points = judged.select("host", "path").distinct().withColumn("labels", labels)
    points = points.select("host", "path", F.explode(suffixes).alias("suffix"))
    ruled = borders.select("suffix").distinct()
    points = points.join(broadcast_if_bounded(ruled, borders.count()), "suffix", "left_semi")
    salt = F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int")
    key = F.concat(_reversed(F.col("suffix")), F.lit("\x00"), F.col("path")).cast("binary")
    points = points.select("suffix", salt.alias("salt"), key.alias("key"), F.lit(1).alias("kind"), "host", "path")
    copies = borders.select(
        "suffix",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        "key",
        F.lit(0).alias("kind"),
        "rule",
    )
    rows = copies.unionByName(points, allowMissingColumns=True)
    sweep = Window.partitionBy("suffix", "salt").orderBy("key", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # a border without an open rule has to count, so the struct around the rule is what is carried on
    border = F.when(F.col("kind") == 0, F.struct("rule"))
    swept = rows.withColumn("open", F.last(border, ignorenulls=True).over(sweep))
    found = swept.filter("kind = 1 AND open.rule IS NOT NULL").select("host", "path", "open.rule")
    best = work.write(found.groupBy("host", "path").agg(F.max("rule").alias("best")), "best")
    return judged.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
