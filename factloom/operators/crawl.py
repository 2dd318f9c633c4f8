"""What stands in front of a fetch: robots rules, and one request at a time for each domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.urls import host, robots_allowed
from factloom.operators import scan


def rate_limited(requests: DataFrame, domain: str, at: str, order: str, interval: float | Column) -> DataFrame:
    """When each request may go: not before `interval` seconds after the one before it in its domain (the same for all of a domain).

    t(i) = max(now(i), t(i-1) + d) has the closed form max over j <= i of (now(j) - j d) + i d: a running number and a
    running maximum. Both are scans over ranges of (domain, time), so no task reads more than its range, whatever share
    of the requests one domain has.
    """
    seconds = interval if isinstance(interval, Column) else F.lit(float(interval))
    rows = requests.withColumn("_now", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_step", F.round(seconds * 1_000_000).cast("long"))
    keys, by = [domain], [at, order]
    own = scan.dealt(rows, keys, by)
    own = own.withColumn("_n", F.row_number().over(scan.within(keys, by)).cast("long"))
    own = own.withColumn("_lead", F.max(F.col("_now") - F.col("_n") * F.col("_step")).over(scan.within(keys, by)))
    sums = scan.totals(own, keys, c=F.count("*"), m=F.max("_lead"), step=F.max("_step"))
    sums = sums.withColumn("_off", F.coalesce(F.sum("c").over(scan.before(keys)), F.lit(0)))
    carry = sums.select(*keys, scan.RANGE, "_off", F.max(F.col("m") - F.col("_off") * F.col("step")).over(scan.before(keys)).alias("_most"))
    out = scan.carried(own, carry, keys)
    off = F.coalesce("_off", F.lit(0))
    lead = F.greatest(F.col("_lead") - off * F.col("_step"), "_most")
    return out.withColumn("granted_at", F.timestamp_micros(lead + (F.col("_n") + off) * F.col("_step"))).select(*requests.columns, "granted_at")


def schedule(pages: DataFrame, robots: DataFrame, agent: str, at: str = "at", order: str = "url", interval: float = 1.0) -> DataFrame:
    """The pages (url, at, ...) that robots (host, body) allow, and when each may be fetched: the host's crawl delay apart, or `interval`."""
    allowed = robots_allowed(pages, robots, agent).where("allowed").withColumn("host", host(F.col("url")))
    return rate_limited(allowed, "host", at, order, F.coalesce("crawl_delay", F.lit(float(interval))))
