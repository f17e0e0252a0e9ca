"""Gates, quotas, attribution and funnels over the event table, as windows and single aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.functions.dialect import DUCK, SPARK
from larder.operators.ranks import funnel_states, ranked
from larder.sources import payloads as S
from larder.sources.folders import shared
from larder.streaming import jobs as J

QUERIES: dict = {}
ORACLE_SQL: dict = {}

SECONDS = {"spark": "unix_timestamp(cast(ts as timestamp))", "duck": "cast(floor(epoch(ts)) as bigint)"}
DAYS = {"spark": "interval 7 days", "duck": "interval 7 day"}


def register(name: str, sql: str, tables=("events",)) -> None:
    """A query of the same SQL in both engines, but for the words in {braces}."""

    def words(engine: str) -> str:
        return sql.replace("{seconds}", SECONDS[engine]).replace("{week}", DAYS[engine]).replace("{day}", "interval 24 hours")

    def query(spark, sf_dir):
        text = words("spark")
        for t in tables:
            text = text.replace(f"from {t}", "from {" + t + "}").replace(f"join {t}", "join {" + t + "}")
        return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables if "{" + t + "}" in text})

    QUERIES[name], ORACLE_SQL[name] = query, words("duck")


#: The n-th request of an identity in its fixed window passes while n is within the limit.
GATE = """select event_id, event_type, user_id, ts, floor({seconds} / 86400) as win,
  row_number() over (partition by event_type, user_id, floor({seconds} / 86400) order by ts, event_id) as n from events"""
register("w5_rate_limit", f"select event_id, n, n <= 2 as allowed, greatest(0, 2 - n) as remaining from ({GATE}) g")
#: Only requests that passed W5 count towards the day's ceiling. Spark ranks them in parts of bounded size.
MOST_A_DAY = 40


def w6_daily_ceiling(spark, sf_dir):
    gate = spark.sql(f"select event_id, event_type, ts, floor({SECONDS['spark']} / 86400) as day from ({GATE}) g where n <= 2".replace("{seconds}", SECONDS["spark"]).replace("from events", "from {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return ranked(gate, ["event_type", "day"], ["ts", "event_id"], "n_day").select("event_id", F.col("n_day").cast("long").alias("n_day"), (F.col("n_day") <= MOST_A_DAY).alias("allowed"))


QUERIES["w6_daily_ceiling"] = w6_daily_ceiling
ORACLE_SQL["w6_daily_ceiling"] = f"""with passed as (select event_id, event_type, ts, floor(epoch(ts) / 86400) as day from ({GATE.replace("{seconds}", SECONDS["duck"])}) g where n <= 2)
select event_id, row_number() over (partition by event_type, day order by ts, event_id) as n_day, row_number() over (partition by event_type, day order by ts, event_id) <= {MOST_A_DAY} as allowed from passed"""
register("w7_quota", "select event_id, user_id, c as used, c < 3 as free, saves, saves < 25 as may_save from (select event_id, user_id, event_type, count(*) over (partition by user_id, event_type order by ts, event_id rows between unbounded preceding and current row) - 1 as c, count_if(event_type = 'click') over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as saves from events) q where event_type = 'view'")
register(
    "w8_saves_since_export",
    """with islands as (select event_id, user_id, event_type, ts, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as island from events)
select event_id, cast(sum(case when event_type = 'click' then 1 else 0 end) over (partition by user_id, island order by ts, event_id rows between unbounded preceding and current row) as bigint) as saves from islands""",
)
TOUCH = "select user_id, min_by(event_id, ts) as event_id, min(ts) as touched from events where event_type = 'view' and user_id % 3 <> 0 group by user_id"
#: Fixed values: the campaign's parameters, and how long a value may be.
UTM, LONGEST = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"), 200
#: Visits with an address made of the event: some organic, some with an empty or very long parameter.
_ADDRESS = """concat('https://x.example/', event_type, '?k=', value, case event_id % 4 when 0 then '' when 1 then concat('&utm_source=s%20', user_id % 7, '&utm_source=second&utm_medium=') when 2 then concat('&utm_campaign=', repeat('long+', 60), event_id, '#utm_term=no') else concat('&utm_term=t', event_id, '&utm_content=', props) end)"""


def first_touch_sql(d, events: str) -> str:
    """(user_id, first_utm_..., first_landing_path, first_touch_at): the first visit of a user whose address has any campaign parameter."""
    query = d.extract("address", "^[^?#]*[?]([^#]*)")
    param = lambda name: f"nullif(substring({'try_url_decode' if d.name == 'spark' else 'url_decode'}(replace({d.extract(query, f'(?:^|&){name}=([^&]*)')}, '+', ' ')), 1, {LONGEST}), '')"
    path = f"substring({d.extract('address', '^[a-z]+://[^/?#]*([^?#]*)')}, 1, {LONGEST})"
    read = f"select user_id, ts, event_id, {', '.join(f'{param(u)} as {u}' for u in UTM)}, {path} as landing_path from ({events}) visits"
    pack = "named_struct(" + ", ".join(f"'{c}', {c}" for c in (*UTM, "landing_path", "ts")) + ")" if d.name == "spark" else "struct_pack(" + ", ".join(f"{c} := {c}" for c in (*UTM, "landing_path", "ts")) + ")"
    first = f"select user_id, min_by({pack}, {'struct' if d.name == 'spark' else 'row'}(ts, event_id)) as t from ({read}) r where coalesce({', '.join(UTM)}) is not null group by user_id"
    return f"select user_id, {', '.join(f't.{u} as first_{u}' for u in UTM)}, t.landing_path as first_landing_path, t.ts as first_touch_at from ({first}) f"


def w9_first_touch(spark, sf_dir):
    return spark.sql(first_touch_sql(SPARK, f"select user_id, ts, event_id, {_ADDRESS} as address from {{events}}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


QUERIES["w9_first_touch"], ORACLE_SQL["w9_first_touch"] = w9_first_touch, first_touch_sql(DUCK, f"select user_id, ts, event_id, {_ADDRESS} as address from events")
register("j12_first_touch_join", f"select e.event_id, e.user_id, t.event_id as touch_event from events e left join ({TOUCH}) t on e.user_id = t.user_id and e.ts >= t.touched")
register("j13_attribute_within", "select c.event_id, count(p.event_id) as returns from (select * from events where event_type = 'click') c left join (select * from events where event_type = 'purchase') p on c.user_id = p.user_id and p.ts > c.ts and p.ts <= c.ts + {week} group by c.event_id")
#: The steps of the funnels: activation (page, recipe read, saved, planned, checkout), visitors by a shared link, upgrades.
#: The fourth, revenue by campaign, is the last step of the first and of the third by the campaign of the first touch.
FUNNELS = (("activation", ("view", "click", "signup", "error", "purchase")), ("shared", ("shared view", "signup", "click")), ("upgrade", ("signup", "purchase")))


def a13_funnel(spark, sf_dir):
    """(funnel, campaign, step, users): users who reached at least that step of a funnel, all funnels from one scan."""
    kind = lambda step: (F.col("event_type") == step.split()[-1]) & (F.lit(True) if " " not in step else F.col("event_id") % 4 == 0)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    campaign = F.when((F.col("event_type") == "view") & (F.col("user_id") % 3 != 0), F.col("event_id") % 5)
    users = funnel_states(events, "user_id", ["ts", "event_id"], [[kind(s) for s in steps] for _, steps in FUNNELS], {"campaign": campaign})
    own = F.coalesce(F.col("campaign").cast("string"), F.lit("organic"))
    rows = [F.struct(F.lit(name).alias("funnel"), (F.lit("all") if name != "upgrade" else own).alias("campaign"), F.lit(step + 1).cast("long").alias("step"), (F.get("reached", F.lit(k)) > step).alias("there")) for k, (name, steps) in enumerate(FUNNELS) for step in range(len(steps))]
    rows += [F.struct(F.lit("revenue").alias("funnel"), own.alias("campaign"), F.lit(place + 1).cast("long").alias("step"), (F.get("reached", F.lit(k)) == len(FUNNELS[k][1])).alias("there")) for place, k in enumerate((0, 2))]
    return users.select(F.inline(F.array(*rows))).groupBy("funnel", "campaign", "step").agg(F.count_if("there").alias("users"))


def _reached(k: int, steps) -> str:
    """SQL of one funnel: the place of the first event of each step after that of the step before, step by step."""
    kind = lambda s: f"event_type = '{s.split()[-1]}'" + (" and event_id % 4 = 0" if " " in s else "")
    out = f"f{k}_0 as (select distinct user_id, 0 as at from placed)"
    for n, s in enumerate(steps):
        out += f", f{k}_{n + 1} as (select p.user_id, min(place) as at from placed p join f{k}_{n} f on p.user_id = f.user_id and p.place > f.at where {kind(s)} group by p.user_id)"
    return out


QUERIES["a13_funnel"] = a13_funnel
ORACLE_SQL["a13_funnel"] = f"""with placed as (select *, row_number() over (partition by user_id order by ts, event_id) as place from events),
users as (select u.user_id, coalesce(campaign, 'organic') as campaign from (select distinct user_id from events) u left join (select user_id, (arg_min(event_id, ts) % 5)::varchar as campaign from events where event_type = 'view' and user_id % 3 <> 0 group by user_id) c using (user_id)),
{', '.join(_reached(k, steps) for k, (_, steps) in enumerate(FUNNELS))}
""" + " union all ".join(
    [
        f"select '{name}' as funnel, {'campaign' if name == 'upgrade' else repr('all')} as campaign, {n + 1}::bigint as step, count(f.user_id) as users from users u left join f{k}_{n + 1} f using (user_id) group by all"
        for k, (name, steps) in enumerate(FUNNELS)
        for n in range(len(steps))
    ]
    + [f"select 'revenue', campaign, {place}::bigint, count(f.user_id) from users u left join f{k}_{len(FUNNELS[k][1])} f using (user_id) group by all" for place, k in ((1, 0), (2, 2))]
)
register("a14_campaign_conversions", f"select t.event_id % 5 as campaign, count(distinct case when e.event_type = 'click' then e.user_id end) as clickers, count(distinct case when e.event_type = 'purchase' then e.user_id end) as buyers from events e join ({TOUCH}) t on e.user_id = t.user_id where e.ts >= t.touched group by t.event_id % 5")
register("a15_saves_before_first", "select e.user_id, count_if(e.event_type = 'click' and (f.t is null or e.ts < f.t)) as saves from events e left join (select user_id, min(ts) as t from events where event_type = 'purchase' group by user_id) f on e.user_id = f.user_id group by e.user_id")
#: Fixed value: the saves that are free.
CAP = 25
register("a16_cap_cohort", f"select count(*) as users, count_if(saves >= {CAP} and upgrades = 0) as capped, floor(count_if(saves >= {CAP} and upgrades = 0) * 10000.0 / count(*) + 0.5) / 10000 as share from (select user_id, count_if(event_type in ('click', 'view')) as saves, count_if(event_type = 'purchase' and event_id % 20 = 0) as upgrades from events group by user_id) u")
#: Fixed value: hours for which a row is fresh.
register("p16_fresh_only", "select event_id from events where ts >= (select max(ts) from events) - {day}")


def o6_recent_k(spark, sf_dir):
    """Shared recipes by their last entry, in one list: payloads that do not decode (here every seventh user's) are not admitted."""
    events = J.events(spark, f"{sf_dir}/events.parquet")
    recipe = F.to_json(F.struct(F.concat(F.lit("Recipe "), F.col("user_id").cast("string")).alias("t"), F.array(F.lit("egg")).alias("ig")))
    sent = events.select(F.lit("sitemap").alias("board"), F.col("event_id").alias("id"), F.unix_micros("ts").alias("at"), F.when(F.col("user_id") % 7 == 0, F.lit("broken")).otherwise(S.pack(recipe)).alias("member"))
    admitted = S.decode_payloads(sent, "member").where("recipe is not null")
    place = F.row_number().over(Window.partitionBy("board").orderBy(F.desc("at"), "member"))  # a bounded list
    lists = J.recent_lists(admitted, shared(spark)).withColumn("place", place)
    return S.decode_payloads(lists, "member").select(F.col("place").cast("long").alias("place"), F.col("recipe.t").alias("title"), F.timestamp_micros("at").cast("timestamp_ntz").alias("last_seen"))


QUERIES["o6_recent_k"] = o6_recent_k
ORACLE_SQL["o6_recent_k"] = """select row_number() over (order by last_seen desc) as place, 'Recipe ' || user_id as title, last_seen from (select user_id, max(ts) as last_seen from events where user_id % 7 <> 0 group by user_id) u qualify place <= 10000"""
