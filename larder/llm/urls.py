"""Operator 5: URL filters by a temporal list join, with DataFrame functions only.

Dated list entries (list, effect, kind, pattern, action, at) become validity intervals:
per pattern, only changes of state stay, and each "add" is valid until the next
"remove". A capture (url, fetch time) has a key for each pattern that could cover it:
its host, each domain suffix of it, and each path prefix. An as-of join on the key with
the fetch time inside the interval finds the entries active at that time. A capture is
blocked if a "block" entry covers it and no "allow" entry does.

The lists are broadcast only where Spark itself finds them under its size limit. Else
both sides are shuffled by key; one very common host or domain makes large partitions
on the captures' side only, which AQE splits. The answers of a capture's keys are
summed up before the second shuffle. Nothing is sorted by time across captures.

Cases: a null url, or one without scheme and host, has no key: it is kept, unblocked,
with host "". A null fetch time meets no interval. At the same time "add" counts over
"remove"; a second "add" without "remove" between changes nothing. Repeated entries
count once, repeated captures each for themselves. Extra columns of captures stay
(those called like the results, in any case, are overwritten), whatever their names. With an empty list nothing is blocked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import column, others, row, unpacked

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """(list, effect, kind, pattern, valid_from, valid_to): when each pattern is on its list; valid_to is exclusive, null if still valid."""
    keys = ["list", "effect", "kind", "pattern"]
    states = entries.where("at is not null").groupBy(*keys, "at").agg(F.max(F.col("action") == "add").alias("on"))
    per_pattern = Window.partitionBy(*keys).orderBy("at")
    changed = states.withColumn("was", F.lag("on").over(per_pattern)).where(F.col("on") != F.coalesce("was", F.lit(False)))
    ended = changed.withColumn("valid_to", F.lead("at").over(per_pattern))
    return ended.where("on").select(*keys, F.col("at").alias("valid_from"), "valid_to")


def keys(url: str = "url"):
    """All (kind, pattern) that could cover the url."""
    host = F.lower(F.regexp_extract(F.col(url), HOST, 1))
    labels = F.split(host, "[.]")
    parts = F.filter(F.split(F.regexp_extract(F.col(url), PATH, 1), "/"), lambda p: p != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    prefixes = F.transform(parts, lambda p, i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/")).alias("pattern")))
    alone = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.when(host != "", F.concat(alone, domains, prefixes))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with host, n_active (entries active at fetch time that cover it), blocked and reasons (joined, in order)."""
    kept = others(captures, ("host", "n_active", "blocked", "reasons"))
    asked = captures.select(F.monotonically_increasing_id().alias("_row"), row(captures, others(captures, kept)), column(url).alias("_url"), column(fetched).alias("_at"))
    one = asked.select("_row", "row", "_url", "_at", F.explode_outer(keys("_url")).alias("_key"))
    valid = intervals(entries)
    inside = (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    met = one.join(valid, (F.col("_key.kind") == F.col("kind")) & (F.col("_key.pattern") == F.col("pattern")) & inside, "left")
    said = F.when(F.col("list").isNotNull(), F.concat_ws(":", "list", "effect", "kind", "pattern"))
    told = met.groupBy("_row").agg(
        F.first("row").alias("row"),
        F.first("_url").alias("_url"),
        F.count("list").alias("n_active"),
        (F.count_if(F.col("effect") == "block") > 0).alias("_block"),
        (F.count_if(F.col("effect") == "allow") > 0).alias("_allow"),
        F.array_join(F.array_sort(F.collect_set(said)), ",").alias("reasons"),
    )
    host = F.coalesce(F.lower(F.regexp_extract("_url", HOST, 1)), F.lit(""))
    return told.select(*unpacked(kept), host.alias("host"), "n_active", (F.col("_block") & ~F.col("_allow")).alias("blocked"), "reasons")


def bound_captures(pages: DataFrame) -> DataFrame:
    """The pages as captures: each has a fetch day in 2024 by its page_id (the table has no time)."""
    return pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 37, 365) as int))").alias("fetched"))


def bound_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries over the hosts, domains and first path parts that the pages have (no list is given)."""
    part = F.regexp_extract("url", PATH, 1)
    seen = pages.select(F.lower(F.regexp_extract("url", HOST, 1)).alias("host"), F.split(part, "/").alias("parts")).where("host <> ''")
    names = F.array(
        F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern")),
        F.struct(F.lit("domain").alias("kind"), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("pattern")),
        F.struct(F.lit("prefix").alias("kind"), F.concat("host", F.lit("/"), F.coalesce(F.get("parts", F.lit(1)), F.lit(""))).alias("pattern")),
    )
    patterns = seen.select(F.explode(names).alias("x")).select("x.*").where("pattern <> '' and not endswith(pattern, '/')").distinct()
    h = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long")
    dated = patterns.withColumn("h", h).where(F.col("h") % 3 != 0)
    day = lambda n: F.expr(f"date_add(date'2024-01-01', cast(h % 150 + {n} as int))")
    entries = F.array(
        F.struct(F.lit("add").alias("action"), day(0).alias("at")),
        F.struct(F.when(F.col("h") % 2 == 0, "remove").otherwise("add").alias("action"), day(60).alias("at")),
        F.struct(F.lit("add").alias("action"), day(150).alias("at")),
    )
    chosen = dated.select(F.when(F.col("h") % 5 == 0, "trusted").otherwise("harmful").alias("list"), F.when(F.col("h") % 5 == 0, "allow").otherwise("block").alias("effect"), "kind", "pattern", F.explode(entries).alias("e"))
    return chosen.select("list", "effect", "kind", "pattern", "e.*")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return evaluate(bound_captures(pages), bound_entries(pages))


OP5_SQL = r"""
with captures as (
  select page_id, url, date '2024-01-01' + cast((page_id * 37) % 365 as integer) as fetched,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) as host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), '/'), lambda x: x <> '') as parts
  from pages),
patterns as (
  select 'host' as kind, host as pattern from captures where host <> ''
  union select 'domain', regexp_extract(host, '([^.]+\.[^.]+)$', 1) from captures where host <> ''
  union select 'prefix', host || '/' || parts[1] from captures where host <> '' and len(parts) > 0),
hashed as (select kind, pattern, cast('0x' || substr(md5(pattern), 1, 6) as bigint) as h from patterns where pattern <> ''),
entries as (
  select case when h % 5 = 0 then 'trusted' else 'harmful' end as list, case when h % 5 = 0 then 'allow' else 'block' end as effect, kind, pattern,
    date '2024-01-01' + cast(h % 150 + n as integer) as dated, n = 60 and h % 2 = 0 as removed
  from hashed, (values (0), (60), (150)) t(n) where h % 3 <> 0),
changed as (
  select *, lag(removed) over (partition by list, effect, kind, pattern order by dated) as was from entries),
valid as (
  select list, effect, kind, pattern, dated as valid_from, lead(dated) over (partition by list, effect, kind, pattern order by dated) as valid_to, removed
  from changed where removed <> coalesce(was, true)),
asked as (
  select page_id, fetched, 'host' as kind, host as pattern from captures where host <> ''
  union all select page_id, fetched, 'domain', array_to_string(string_split(host, '.')[i:], '.') from captures, unnest(range(1, len(string_split(host, '.')) + 1)) t(i) where host <> ''
  union all select page_id, fetched, 'prefix', host || '/' || array_to_string(parts[1:i], '/') from captures, unnest(range(1, len(parts) + 1)) t(i) where host <> ''),
met as (
  select a.page_id, v.* from asked a join valid v on a.kind = v.kind and a.pattern = v.pattern and not v.removed
    and a.fetched >= v.valid_from and (v.valid_to is null or a.fetched < v.valid_to)),
told as (
  select page_id, count(*) as n, bool_or(effect = 'block') as b, bool_or(effect = 'allow') as a,
    string_agg(list || ':' || effect || ':' || kind || ':' || pattern, ',' order by list || ':' || effect || ':' || kind || ':' || pattern) as reasons
  from met group by page_id)
select c.page_id, url, fetched, host, coalesce(n, 0) as n_active, coalesce(b and not a, false) as blocked, coalesce(reasons, '') as reasons
from captures c left join told t on c.page_id = t.page_id
"""

QUERIES = {"op5_urls": op5_urls}
ORACLE_SQL = {"op5_urls": OP5_SQL}
