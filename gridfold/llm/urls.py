"""URL rules by a sort-merge range join over reversed-host keys.

A rule (host, path) and a URL become keys (host labels from the right, path).  A URL asks once
for each of its parent hosts; under such a key a rule covers exactly the keys of the same host
whose path begins with its own, an interval of the sort order.  Intervals nest, so a sorted sweep
needs only a stack of the rules it is inside of.
"""
from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_PART = 50_000   # probes a sweep handles, about
SAMPLE = 100_000    # probes looked at to choose the cuts between sweeps
MOST_PARTS = 4096   # ranges at most, so that the cuts stay few however many probes there are
CUT_LENGTH = 256    # characters of a sampled key that a cut keeps; any key is a valid cut
LAST = "\U0010ffff"  # sorts after every character


def split_url(url: str = "url") -> tuple[Column, Column]:
    """(host, path) of a URL: after the first ``://`` up to ``/ ? #`` with A-Z lowered, then up to
    ``? #``; both empty where the URL is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(F.col(url), F.instr(url, "://") + 3, F.lit(2**31 - 1)))
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def sort_key(labels: list[str], path: str) -> tuple:
    return (tuple(labels), path)


def past(labels: tuple, path: str) -> tuple:
    """The first key behind all keys of the same host whose path begins with ``path``."""
    path = path.rstrip(LAST)
    return (labels, path[:-1] + chr(ord(path[-1]) + 1)) if path else ((*labels, ""), "")


def sweep(group: pd.DataFrame) -> pd.DataFrame:
    """Longest rule for each probe of one range: rules come before equal probes, and a rule leaves
    the stack at the first key outside its interval."""
    host = [tuple(x) for x in group["labels"]]
    path = group["path"].tolist()
    rule = group["rule"].tolist()
    order = sorted(range(len(group)), key=lambda i: (host[i], path[i], rule[i] is None))
    stack: list[int] = []
    found = np.full(len(group), -1)
    for i in order:
        while stack and not (host[stack[-1]] == host[i] and path[i].startswith(path[stack[-1]])):
            stack.pop()
        if rule[i] is not None:
            stack.append(i)
        elif stack:
            found[i] = stack[-1]
    hit = found >= 0
    best = found[hit]
    return pd.DataFrame({"host": group["host"].to_numpy()[hit], "full_path": group["full_path"].to_numpy()[hit],
                         "rule": group["rule"].to_numpy()[best], "verdict": group["verdict"].to_numpy()[best], "depth": group["depth"].to_numpy()[best]})


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path; distinct) x ``rules`` (host, path, verdict) -> host, path, rule, verdict of the longest
    rule that fits, for the URLs that any fits.

    Length is that of host and path together; between equal lengths the longer host wins, then
    ``allow``.  The key space is cut at quantiles of a bounded sample into ranges of about PER_PART probes;
    a key that fills several ranges is dealt over them, and a rule is sent to each range its
    interval meets.
    """
    spark = urls.sparkSession
    reverse = lambda c: F.reverse(F.split(c, r"\."))
    probes = urls.where("host <> ''").select("host", F.col("path").alias("full_path"), "path", reverse(F.col("host")).alias("_all"))
    probes = probes.withColumn("labels", F.explode(F.transform(F.sequence(F.lit(1), F.size("_all")), lambda i: F.slice("_all", 1, i)))).drop("_all")
    given = rules.where("host is not null and path is not null").select(reverse(F.col("host")).alias("labels"), "path", F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("depth"))
    given = given.groupBy("labels", "path", "rule", "depth").agg(F.min("verdict").alias("verdict"))
    n = probes.count()
    parts = min(max(1, -(-n // PER_PART)), MOST_PARTS)
    sample = [] if parts == 1 else [sort_key(r["labels"], r["path"]) for r in probes.select("labels", F.substring("path", 1, CUT_LENGTH).alias("path")).sample(min(1.0, SAMPLE / n), seed=7).collect()]  # bounded
    sample.sort()
    cuts = [sample[len(sample) * k // parts] for k in range(1, parts)] if sample else []
    cuts_b = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("array<int>")
    def ranges(labels: pd.Series, path: pd.Series, is_rule: pd.Series) -> pd.Series:
        out, cuts = [], cuts_b.value
        for a, p, r in zip(labels, path, is_rule):
            key = (tuple(a), p)
            out.append([bisect.bisect_left(cuts, key), bisect.bisect_left(cuts, past(*key)) if r else bisect.bisect_right(cuts, key)])
        return pd.Series(out)

    span = probes.withColumn("_r", ranges("labels", "path", F.lit(False)))
    width = F.col("_r")[1] - F.col("_r")[0] + 1
    dealt = span.withColumn("part", F.col("_r")[0] + F.pmod(F.xxhash64("host", "full_path"), width).cast("int"))
    sent = given.withColumn("_r", ranges("labels", "path", F.lit(True))).withColumn("part", F.explode(F.sequence(F.col("_r")[0], F.col("_r")[1])))
    empty, none = F.lit(None).cast("string"), F.lit(None).cast("int")
    both = dealt.select("part", "labels", "path", "host", "full_path", empty.alias("rule"), empty.alias("verdict"), none.alias("depth")).unionByName(
        sent.select("part", "labels", "path", empty.alias("host"), empty.alias("full_path"), "rule", "verdict", "depth"))
    swept = both.groupBy("part").applyInPandas(sweep, "host string, full_path string, rule string, verdict string, depth int")
    rank = F.struct(F.length("rule"), "depth", F.when(F.col("verdict") == "allow", 1).otherwise(0), "rule", "verdict")
    best = swept.groupBy("host", F.col("full_path").alias("path")).agg(F.max(rank).alias("_b"))
    return best.select("host", "path", F.col("_b.rule").alias("rule"), F.col("_b.verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every page; ``otherwise`` where no rule fits.

    Equal URLs are judged once and the verdict is joined back, so a URL shared by most pages is
    one probe.  Null and malformed URLs have empty host and path and fit no rule.
    """
    host, path = split_url("url")
    slim = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = match_rules(slim.select("host", "path").distinct(), rules)
    return (slim.join(found, ["host", "path"], "left")
            .select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict")))
