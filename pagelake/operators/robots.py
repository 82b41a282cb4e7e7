"""Crawl permission of URLs under a table of robots rules, and allowed domains."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import urls

#: The last character there is: no text that starts with a path lies beyond the path and this.
LAST = "\U0010ffff"
#: A host has fewer points than two to this power and one.
MOST_POINTS_BITS = 30


def _agent_rules(rules: DataFrame, agent: str) -> DataFrame:
    """Each host's rules for this agent: a group that names it, else the ``*`` group.

    Reduced to one rule per (host, path), the first in file order, since a later
    rule for the same path can never decide.
    """
    token = agent.split("/")[0].lower()
    name = F.lower("agent")
    mine = rules.filter((name == "*") | F.contains(F.lit(token), name))
    chosen = mine.groupBy("host").agg(
        F.min_by(F.col("agent"), F.struct((name == "*").alias("any"), F.col("ordinal"))).alias("agent")
    )
    # An empty Disallow allows everything below it.
    allow = F.col("allow") | (F.col("path") == "")
    return (
        mine.join(chosen, ["host", "agent"], "left_semi")
        .groupBy("host", urls.unescaped(F.col("path")).alias("path"))
        .agg(F.min(F.struct("ordinal", allow.alias("allow"))).alias("rule"))
    )


def compiled(rules: DataFrame, agent: str = "*") -> DataFrame:
    """``(host, points)``: where in the order of paths the verdict changes, and to what.

    A rule holds from its path up to, not including, the first text that does not start with it. At either end
    the first rule in file order among those that hold there decides, which are prefixes of the path;
    they are looked up by equality, for rules only, never for URLs.
    """
    rules = _agent_rules(rules, agent)
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    prefixes = (
        rules.select("host", "path").join(lengths, "host").select("host", "path", F.explode("lengths").alias("n"))
        .filter(F.length("path") >= F.col("n")).select("host", "path", F.expr("left(path, n)").alias("prefix"))
    )
    held = prefixes.join(rules.select("host", F.col("path").alias("prefix"), "rule"), ["host", "prefix"])
    outer = F.when(F.col("prefix") != F.col("path"), F.col("rule"))
    ends = held.groupBy("host", "path").agg(F.min("rule")["allow"].alias("inside"), F.min(outer)["allow"].alias("after"))
    points = F.array(
        F.struct(F.col("path").alias("at"), F.col("inside").alias("allow")),
        F.struct(F.concat("path", F.lit(LAST)).alias("at"), F.coalesce("after", F.lit(True)).alias("allow")),
    )
    return ends.select("host", F.explode(points).alias("p")).groupBy("host").agg(F.array_sort(F.collect_list("p")).alias("points"))


def _verdict(points: Column, target: Column) -> Column:
    """What holds at the last point that is not above a text, found by halving; allowed before the first."""
    steps = F.transform(F.sequence(F.lit(MOST_POINTS_BITS), F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k))

    def halve(at: Column, step: Column) -> Column:
        return F.when(F.get(points, at + step - 1)["at"] <= target, at + step).otherwise(at)

    last = F.aggregate(steps, F.lit(0), halve) - 1
    return F.coalesce(F.when(last >= 0, F.get(points, last)["allow"]), F.lit(True))


def robots_allowed(
    pages: DataFrame, rules: DataFrame, agent: str = "*", url: str = "url", key: str = "page_id"
) -> DataFrame:
    """Add ``allowed``: the first rule in file order whose path starts the URL's path decides.

    ``rules(host, agent, ordinal, allow, path)``. Escapes are resolved on both sides. A host's rules
    are compiled to sorted points, one row for a host, and a URL is placed between them: one
    join on the host, whose larger side adaptive execution splits, and no further grouping.
    """
    target = F.concat(
        F.when(urls.path(url) == "", F.lit("/")).otherwise(urls.path(url)),
        F.when(urls.query(url) != "", F.concat(F.lit("?"), urls.query(url))).otherwise(""),
    )
    asked = pages.withColumns({"_host": F.lower(urls.netloc(url)), "_target": urls.unescaped(target)})
    points = compiled(rules, agent).select(F.col("host").alias("_host"), F.col("points").alias("_points"))
    return asked.join(points, "_host", "left").withColumn("allowed", _verdict(F.col("_points"), F.col("_target"))).drop("_host", "_target", "_points")


def allowed_domains(pages: DataFrame, domains: Iterable[str], url: str = "url") -> DataFrame:
    """Pages on one of the domains or below it."""
    host = F.regexp_replace(urls.host_key(url), r":\d+$", "")
    keep = F.lit(False)
    for d in domains:
        keep = keep | (host == d.lower()) | host.endswith("." + d.lower())
    return pages.filter(keep)
