"""URL filters by a temporal list join: each capture is judged by the list as it stood when the page was fetched.

Only DataFrame functions are used. A list is a log of dated entries: a rule is added or removed. A rule is a domain
(it covers the host and everything below it) or a host with leading path segments; hosts are compared in lower case,
paths as they stand. The log becomes one row for each
rule with its validity intervals; a capture is looked up under every rule that could cover it (the ends of its host,
the beginnings of its path) and its rule is in force if the fetch time lies in an interval, which is the as-of join.
No more domain levels or path segments are tried than the longest rule has. Rules that cover many captures are looked
up by broadcast, a bounded number of them, and the rest by a shuffled join (`lookup_join`).

Defined cases: a null or malformed url has no host and is not blocked; a null fetch time lies in no interval; entries
with a null rule or time say nothing; of entries for one rule at one time an addition wins; repeated entries count
once; repeated captures keep their rows; urls of any length are taken whole; empty captures give an empty result and an
empty list blocks nothing; only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.lookup import lookup_join
from millrace.runtime import settle
from millrace.schema import col

HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and closing dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.+$", "")


def segments_of(url: Column) -> Column:
    path = F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def intervals(entries: DataFrame, rule_col: str = "rule", action_col: str = "action", time_col: str = "at") -> DataFrame:
    """key and spans (array of since, until), for each rule that was ever added."""
    rule = F.regexp_replace(col(rule_col), r"^\*?\.|/+$", "")
    host = F.substring_index(rule, "/", 1)
    # Paths keep their case, as those of captures do.
    key = F.concat(F.lower(host), F.substr(rule, F.length(host) + 1))
    log = (entries.select(key.alias("key"), col(time_col).alias("at"), (col(action_col) == "add").alias("added"))
           .filter(F.col("key").isNotNull() & (F.col("key") != "") & F.col("at").isNotNull())
           .groupBy("key", "at").agg(F.max("added").alias("added")))
    by_key = Window.partitionBy("key").orderBy("at")
    spans = log.withColumn("until", F.lead("at").over(by_key)).filter("added")
    return spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("since"), "until"))).alias("spans"))


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url",
          time_col: str = "fetched") -> DataFrame:
    """id, host, fetch time, blocked, and the rule in force with its date (the longest rule, then the first by name)."""
    rules = settle(intervals(entries), "rules")
    deepest = rules.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))).alias("labels"),
                        F.max(F.size(F.split("key", "/")) - 1).alias("segments")).first()
    labels, depth = deepest["labels"] or 0, deepest["segments"] or 0
    rows = captures.select(col(id_col).alias("id"), host_of(col(url_col).cast("string")).alias("host"), col(time_col).alias("at"),
                           segments_of(col(url_col).cast("string")).alias("path"))
    rows = rows.withColumn("path", F.slice("path", 1, max(depth, 1)))
    parts = F.split("host", r"\.")
    last = F.size(parts)
    ends = F.transform(F.sequence(F.greatest(last - (labels - 1), F.lit(1)), last),
                       lambda i: F.array_join(F.slice(parts, i, last), "."))
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.size("path")), lambda d: F.when(d > 0, F.concat_ws(
        "/", F.col("host"), F.array_join(F.slice("path", F.lit(1), F.greatest(d, F.lit(1))), "/")))), lambda k: k.isNotNull())
    asked = (rows.filter("host != '' and at is not null")
             .select("id", "host", "at", "path", F.explode(F.concat(ends, starts) if depth else ends).alias("key")))
    tally = asked.groupBy("key").agg(F.count("*").alias("n"))
    table = settle(rules.join(tally, "key").select("key", "n", "spans"), "table")
    total = table.agg(F.sum("n")).first()[0] or 0
    # Only keys with a rule matter, so hot keys are measured among those.
    looked = lookup_join(asked, table, "key", "n", max(total, 1), small=False).filter("spans is not null")
    inside = F.filter("spans", lambda s: (s["since"] <= F.col("at")) & (s["until"].isNull() | (F.col("at") < s["until"])))
    hit = looked.withColumn("span", F.get(inside, F.lit(0))).filter("span is not null")
    best = (hit.groupBy("id", "host", "at", "path")
            .agg(F.min(F.struct((-F.length("key")).alias("short"), "key", F.col("span.since").alias("since"))).alias("best")))
    best = best.select(*[F.col(c).alias(f"m_{c}") for c in ("id", "host", "at", "path")], "best")
    same = (F.col("id").eqNullSafe(F.col("m_id")) & (F.col("host") == F.col("m_host")) & F.col("at").eqNullSafe(F.col("m_at"))
            & (F.col("path") == F.col("m_path")))
    return rows.join(best, same, "left").select(
        F.col("id").alias(id_col), "host", F.col("at").alias(time_col), F.col("best").isNotNull().alias("blocked"),
        F.col("best.key").alias("rule"), F.col("best.since").alias("since"))
