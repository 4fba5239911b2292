"""URL filters by a temporal list join, in DataFrame functions only.

A list has dated entries: (kind, pattern, action, at). kind 'domain' covers a host and its subdomains, kind
'prefix' every URL that continues the pattern after '/', '?', '#' or its end; action 'add' puts the pattern
on the list, 'remove' takes it off. Entries of a pattern become validity intervals [from, to), and each
capture is held against the intervals that were valid when it was fetched: an as-of join on all of the
patterns that could cover its URL.

Hot hosts: intervals are cut at buckets of BUCKET days, and captures meet them by pattern and bucket in an
equi-join whose sides come straight from shuffles, so a hot pattern is spread over its buckets and can be
split further. Intervals are formed within (pattern, bucket) and stitched over one row a bucket, so a
pattern with very many entries does not meet in one task either.

A URL is asked for as many host labels and path steps as the longest patterns of the list have, so patterns
of any length are found and a very long URL costs no more than the list demands.

Hosts are compared in lower case and without the root dot, paths as they are; empty path steps count for
nothing on both sides. Ports count for nothing either. An address in brackets is a host without subdomains.
Times are dates or timestamps. Captures are identified by URL and time, so other columns can be of any type.

Defined cases: a null or hostless URL, or a null fetch time, matches nothing; entries with a null field, an
unknown kind or action, a pattern without a host, or a domain with a path have no effect; of entries of a pattern at the same time
the removal wins; repeated captures each get their result; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import materialize

#: Days in a bucket of the join.
BUCKET = 32
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), "[.]+$", "")


def _steps(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def path_of(url: Column) -> Column:
    return _steps(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1))


def patterns_of(host: Column, parts: Column, path: Column, labels: Column, steps: Column) -> Column:
    """All (kind, pattern) that could cover a URL: host suffixes of at most so many labels, and host with at most so many path steps."""
    suffixes = F.transform(
        F.when(F.least(F.size(parts), labels) > 0, F.sequence(F.lit(1), F.least(F.size(parts), labels))).otherwise(F.array().cast("array<int>")),
        lambda n: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(parts, -n, n), ".").alias("pattern")),
    )
    prefixes = F.transform(
        F.when(steps >= 0, F.sequence(F.lit(0), F.least(F.size(path), steps))).otherwise(F.array().cast("array<int>")),
        lambda n: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", host, F.slice(path, 1, n)).alias("pattern")),
    )
    return F.when(host != "", F.concat(suffixes, prefixes))


def normal_pattern(kind: Column, pattern: Column) -> Column:
    """A list's pattern as patterns_of gives it: host in lower case without outer dots, no empty path steps."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(pattern, "/", 1)), ":[0-9]*$", ""), "^[.]+|[.]+$", "")
    rest = F.when(F.contains(pattern, F.lit("/")), F.expr("substring(pattern, instr(pattern, '/') + 1)")).otherwise("")
    whole = F.concat_ws("/", host, _steps(rest))
    return F.when((host != "") & ((kind != "domain") | (whole == host)), whole)


def _bucket(at: Column) -> Column:
    return F.floor(F.unix_date(at.cast("date")) / BUCKET).cast("bigint")


def validity(entries: DataFrame) -> DataFrame:
    """(kind, pattern, valid_from, valid_to) of the times for which a pattern is on the list; valid_to is null if open."""
    known = entries.where("kind in ('domain', 'prefix') and at is not null and action in ('add', 'remove')")
    known = known.select("kind", normal_pattern(F.col("kind"), F.col("pattern")).alias("pattern"), "action", "at").where("pattern is not null")
    # of a pattern's entries at the same time the removal wins
    dated = known.groupBy("kind", "pattern", "at").agg(F.max("action").alias("action")).withColumn("bucket", _bucket(F.col("at")))
    inside = Window.partitionBy("kind", "pattern", "bucket").orderBy("at")
    chained = dated.withColumn("next", F.lead("at").over(inside))
    firsts = dated.groupBy("kind", "pattern", "bucket").agg(F.min("at").alias("first"))
    after = firsts.withColumn("after", F.lead("first").over(Window.partitionBy("kind", "pattern").orderBy("bucket"))).drop("first")
    joined = chained.join(after, ["kind", "pattern", "bucket"])
    return joined.where("action = 'add'").select("kind", "pattern", F.col("at").alias("valid_from"), F.coalesce("next", "after").alias("valid_to"))


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with n_matches, matched (least matching 'kind:pattern', or null) and blocked.

    fetched and the entries' at are dates or timestamps. Input columns of the result's names are replaced.
    """
    columns = [c for c in captures.columns if c not in ("n_matches", "matched", "blocked")]
    # what is asked is asked once for each URL and time
    keys = captures.select(F.col(url).alias("row_url"), F.col(fetched).alias("at")).where("row_url is not null and at is not null").distinct()
    keys = materialize(keys, "url-captures")
    span = keys.agg(F.min(_bucket(F.col("at"))).alias("lo"), F.max(_bucket(F.col("at"))).alias("hi")).first()
    lo, hi = (span.lo, span.hi) if span.lo is not None else (0, 0)
    # only buckets in which captures were fetched matter
    first = F.greatest(_bucket(F.col("valid_from")), F.lit(lo))
    last = F.least(F.coalesce(_bucket(F.col("valid_to")), F.lit(hi)), F.lit(hi))
    valid = validity(entries).where("valid_to is null or valid_to > valid_from").withColumns({"first": first, "last": last}).where("first <= last")
    valid = materialize(valid.select("kind", "pattern", "valid_from", "valid_to", F.explode(F.sequence("first", "last")).alias("bucket")), "url-intervals")
    longest = lambda kind, cut: F.coalesce(F.max(F.when(F.col("kind") == kind, F.size(F.split("pattern", cut)))), F.lit(0))
    depth = valid.agg(longest("domain", "[.]").alias("labels"), (longest("prefix", "/") - 1).alias("steps")).first()
    host = host_of(F.col("row_url"))
    named = keys.select("row_url", "at", host.alias("host"), path_of(F.col("row_url")).alias("path"))
    named = named.withColumn("parts", F.when(F.startswith("host", F.lit("[")), F.array("host")).otherwise(F.split("host", "[.]")))
    asked = named.select("row_url", "at", F.explode(patterns_of(F.col("host"), F.col("parts"), F.col("path"), F.lit(depth.labels), F.lit(depth.steps))).alias("p"))
    asked = asked.select("row_url", "at", "p.kind", "p.pattern", _bucket(F.col("at")).alias("bucket")).distinct()
    met = asked.join(valid, ["kind", "pattern", "bucket"]).where("valid_from <= at and (valid_to is null or at < valid_to)")
    found = met.groupBy("row_url", "at").agg(F.count("*").alias("__n"), F.min(F.concat_ws(":", "kind", "pattern")).alias("__matched"))
    # written, so that a URL of very many captures can be split in the join
    found = materialize(found.select(F.col("row_url").alias("__u"), F.col("at").alias("__at"), "__n", "__matched"), "url-matches")
    out = captures.select(*columns).join(found, (F.col(url) == F.col("__u")) & (F.col(fetched) == F.col("__at")), "left")
    n = F.coalesce("__n", F.lit(0)).cast("bigint")
    return out.select(*columns, n.alias("n_matches"), F.col("__matched").alias("matched"), (n > 0).alias("blocked"))
