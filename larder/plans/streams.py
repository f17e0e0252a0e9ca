"""Queries that run the streams over the given events, and text queries, with batch SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.functions import text as X
from larder.functions.dialect import DUCK, SPARK
from larder.operators import texts as T
from larder.sources.folders import shared
from larder.streaming import jobs as J


def _counts(seconds: int, most: int | None, *keys: str):
    def query(spark, sf_dir):
        written = J.finish(J.counts(J.events(spark, f"{sf_dir}/events.parquet"), seconds, *keys), shared(spark), "update")
        return J.latest(written, *keys, most=most).withColumn("win", F.unix_timestamp("win"))

    over = "" if most is None else f", n > {most} as over"
    sql = f"""with w as (select cast(floor(epoch(ts) / {seconds}) as bigint) * {seconds} as win, {', '.join(keys)}, count(*) as n from events group by all)
select *{over} from w"""
    return query, sql


def r4_lockout(spark, sf_dir):
    """Attempts of ten accounts, a minute for an hour of the events, so that some accounts are locked."""
    events = J.events(spark, f"{sf_dir}/events.parquet")
    attempts = events.selectExpr("concat('account ', cast(user_id % 10 as string)) as subject", "event_id as id", "event_type <> 'purchase' as failed", "timestamp_micros(unix_micros(ts) div 60) as ts")
    return J.finish(J.lockouts(attempts), shared(spark)).withColumn("failures", F.col("failures").cast("long"))


def r5_dedupe(spark, sf_dir):
    seen = J.once_a_day(J.events(spark, f"{sf_dir}/events.parquet"), "user_id", "event_type")
    return J.finish(seen, shared(spark))


def r6_first_touch(spark, sf_dir):
    return J.finish(J.first_touches(J.events(spark, f"{sf_dir}/events.parquet")), shared(spark), "complete").select("user_id", "event_id")


def r8_upsert(spark, sf_dir):
    return J.upsert(J.events(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type"), shared(spark), "user_id", "event_id")


#: Lines before and behind whole texts: those of sections, labels, sentences, and a long line of ingredients, here as its pieces.
BEFORE = {
    0: ["Title: Soup", "= Ingredients:", "1 cup milk", "- salt", "* 2. pepper", "Addo List", "Method", "1. Heat the milk.", "Stir it well. It is good. Serve it hot. "],
    1: ["[1] Stew", "2 cups beans", "• oil", "3 tomatoes", "Salt, to taste", "1. Wash.", "Stir the beans over low heat. Enjoy. Chill them."],
    2: ["Directions for all", "Place in a bowl", "grocery list", "eggs"],
    3: ["<- 4. Pasta"],
}
BLOB = ["All you want for a good pasta for the four of us", "Salt and pepper, to taste", "1lb pasta of choice", "1/2 cup oil, to taste", "1/2 yellow onion", "3 eggs", "2 tbsp butter at 350 degrees for 20 minutes of baking"]


def _doc_text(d, kind: int) -> str:
    lines = BEFORE[kind] + ([" ".join(BLOB)] if kind == 3 and d.name == "spark" else BLOB if kind == 3 else [])
    return f"concat({d.text(chr(10).join(lines))}, chr(10), text)" if d.name == "duck" else f"concat({d.text(chr(10).join(lines)).replace(chr(10), chr(92) + 'n')}, '\\n', text)"


def _texts(d) -> str:
    return "case doc_id % 4 " + " ".join(f"when {k} then {_doc_text(d, k)}" for k in BEFORE) + " end"


def t1_text_recipes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(_texts(SPARK)).alias("text"))
    return T.text_recipes(docs).select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "part", "k")).cast("long").alias("place"), "kind", "text")


#: Pieces of a long line; a name from the table stands in one of them.
_BLOB_PIECES = ["concat('Of ', p_name, ' take')", "'Pepper and salt, to taste'", "'2 cups flour'", "concat('3 tbsp ', p_brand, ' sugar')", "'1 tsp salt'", "'4 oz of dark chocolate'", "'1/2 red onion'", "'2 eggs baked at 200 degrees for 30 mins'"]


def t2_split_blob(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("line", F.expr(f"concat_ws(' ', {', '.join(_BLOB_PIECES)})"))
    return parts.select("p_partkey", F.array_join(T.split_blob(F.col("line")), "|").alias("pieces"))


_TIMED = "concat(text, ' Bake about 10 to around ', doc_id % 40 + 11, ' minutes, rest 1 Hour and 5 mins; 5-1 hours 20 min, then 90 Secs or 2 hr')"


def q7_step_timers(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(_TIMED).alias("t"))
    found = T.timers(docs, "t").select("doc_id", F.inline("timers"))
    return found.select("doc_id", "seconds", "label", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


def _time_phase(k: int, pattern: str, seconds: str) -> str:
    """SQL of one form of times: its matches in what the forms before left, and the text with them blotted out."""
    return f"""c{k} as (select doc_id, said, regexp_extract_all(t, '(?i){pattern}', 0) as ms, regexp_split_to_array(t, '(?i){pattern}') as ps from b{k}),
b{k + 1} as (select doc_id, said, array_to_string(list_transform(range(1, len(ps) + 1), lambda i: ps[i] || coalesce(repeat(chr(1), length(ms[i])), '')), '') as t from c{k}),
h{k} as (select doc_id, said, ms[i] as m, {seconds} as seconds, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as start
  from (select *, unnest(range(1, len(ms) + 1)) as i from c{k}) x)"""


_UNIT = "(?:minutes?|mins?|hours?|hrs?|seconds?|secs?)"
_BY_UNIT = r"regexp_extract(ms[i], '([0-9]+)\s+[A-Za-z]+$', 1)::bigint * case lower(regexp_extract(ms[i], '([A-Za-z])[A-Za-z]*$', 1)) when 'h' then 3600 when 'm' then 60 else 1 end"
_PHASES = (
    (rf"[0-9]+\s+hours?\s+(?:and\s+)?[0-9]+\s+{_UNIT}", r"regexp_extract(ms[i], '^[0-9]+')::bigint * 3600 + regexp_extract(ms[i], '\s([0-9]+)\s+[A-Za-z]+$', 1)::bigint * 60"),
    (rf"[0-9]+\s*(?:to|-)\s*[0-9]+\s+{_UNIT}", _BY_UNIT),
    (rf"[0-9]+\s+{_UNIT}", _BY_UNIT),
)


def x15_post_texts(spark, sf_dir):
    """Posts with the whole text in their data, some with a caption beside it, some with one that is too short."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = F.to_json(F.struct(F.concat(F.lit("ab "), "text", F.lit("x" * 100)).alias("text")))
    caption = F.expr("""case doc_id % 3 when 0 then concat('"caption" : {"id": 7, "text":"so\\\\n\\\\u00e9 ', repeat('good ', 10), doc_id, '"},') when 1 then '"caption": {"text": "short"},' else '' end""")
    page = F.concat(F.lit('<script>{"text":"short"},'), caption, own, F.lit("</script>"))
    return docs.select("doc_id", T.post_text(page).alias("post"))


#: Result pages of both forms before the real page: adverts, redirects, bare addresses, entries without an address or title; w is a word of the page.
_RESULT = """concat('<div class="result results_links', case when k % 4 = 0 then ' result--ad' else '' end, '"><h2><a rel="x" class="result__a" href="', case when k % 5 = 1 then concat('https://www.b.example/', k) when k % 7 = 2 then '/relative' else concat('//s/?uddg=https%3A%2F%2Fa.example%2F', k, '%3Fq%3D1&r=1') end, '">',
case when k = 9 then '<b> </b>' else concat('<b>T', k, '</b> &amp; ', w) end, '</a></h2>', case when k % 3 = 0 then concat('<a class="result__url" href="x"> shown', k, '.example / path</a>') else '' end, '<a class="result__snippet" href="y">S ', repeat(concat(w, ' '), k * 5), '<b>end</b></a></div>')"""
_ROW = """concat('<tr><td><a rel="nofollow" href="', case when k % 5 = 2 then 'ftp://c' else concat('http://www.c.example/', k) end, '" class="result-link">R', k, ' ', w, '</a></td><td class="result-snippet">about <i>', w, '</i></td>')"""


def x23_search_results(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("w", F.regexp_extract("html", "<title>([A-Za-z]*)", 1))
    every = lambda item, n: f"array_join(transform(sequence(0, {n}), k -> {item}), '')"
    built = pages.select("page_id", F.expr(f"concat(case when page_id % 2 = 0 then {every(_RESULT, 24)} else {every(_ROW, 19)} end, html)").alias("html"))
    return T.search_results(built).withColumn("place", F.col("place").cast("long"))


QUERIES = {f.__name__: f for f in (r4_lockout, r5_dedupe, r6_first_touch, r8_upsert, t1_text_recipes, t2_split_blob, q7_step_timers, x15_post_texts, x23_search_results)}
ORACLE_SQL = {
    # all accounts' attempts one by one, k for k
    "r4_lockout": """with recursive a as (select 'account ' || (user_id % 10) as subject, event_id as id, epoch_us(ts) // 60 as us, event_type <> 'purchase' as failed,
  row_number() over (partition by user_id % 10 order by epoch_us(ts) // 60, event_id) as k from events),
replay as (
  select subject, 0::bigint as k, 0::bigint as n, 0::bigint as since, null::bigint as id, null::varchar as outcome from (select distinct subject from a) s
  union all
  select subject, k, case when outcome = 'failed' then held + 1 when outcome = 'cleared' then 0 else held end, case when outcome = 'failed' and held = 0 then us else since end, id, outcome
  from (select *, case when held >= 5 then 'blocked' when failed then 'failed' else 'cleared' end as outcome
    from (select a.subject, a.k, a.id, a.us, a.failed, r.since, case when r.n > 0 and a.us >= r.since + 900000000 then 0 else r.n end as held from replay r join a on a.subject = r.subject and a.k = r.k + 1) h) o)
select subject, id, outcome, n as failures from replay where id is not null""",
    "r5_dedupe": """with recursive taken as (
  select user_id, event_type, min(epoch_us(ts)) as us from events group by all
  union all
  select t.user_id, t.event_type, min(epoch_us(e.ts)) from taken t join events e on e.user_id = t.user_id and e.event_type = t.event_type and epoch_us(e.ts) >= t.us + 86400000000 group by t.user_id, t.event_type, t.us)
select user_id, event_type, cast(floor(us / 1000000) as bigint) as taken from taken""",
    "r6_first_touch": "select user_id, arg_min(event_id, ts) as event_id from events where event_type = 'view' and user_id % 3 <> 0 group by user_id",
    "r8_upsert": "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id",
    "t1_text_recipes": rf"""with raw as (select doc_id, string_split({_texts(DUCK)}, chr(10)) as ls from documents),
lined as (select doc_id, line, regexp_replace(line, '^\s+|\s+$', '', 'g') as bare, row_number() over (partition by doc_id order by k) as place from (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as k from raw) r where regexp_matches(line, '\S')),
told as (select *, lower(bare) as low, place = 1 and not regexp_matches(lower(bare), '^(?:=\s*)?(?:ingredients|grocery\s*list|instructions|steps|directions|method)\b') as titled,
  trim(regexp_replace(regexp_replace(line, '^[-*•]\s*', ''), '^[0-9]+\.\s*', '')) as clean from lined),
heads as (select *, case when titled then null when regexp_matches(low, '^(?:=\s*)?(?:ingredients|grocery\s*list)\b') then 'i' when regexp_matches(low, '^(?:instructions|steps|directions|method)\b') then 's' end as head from told),
under as (select *, last_value(head ignore nulls) over (partition by doc_id order by place rows between unbounded preceding and current row) as sec,
  list_filter(list_transform(string_split(regexp_replace(clean, '\.\s+([A-Z])', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(regexp_replace(trim(x), '\.$', ''))), lambda x: x <> '') as sent from heads),
kinds as (select *, regexp_matches(bare, '^[0-9]+\.\s') as num, list_filter(sent, lambda s: {X.has_verb(DUCK, 's')}) as good from under where not titled and head is null and clean <> '' and not regexp_matches(low, '^(?:[®<>\[\]]|do category|addo list|plan meal)')),
rows as (select doc_id, place, 0 as k, 'title' as kind, case when titled then trim(regexp_replace(regexp_replace(line, '^[<®=\-\[\]0-9.]+\s*', ''), '(?i)^Title:\s*', '')) else 'Pasted Recipe' end as text from told where place = 1
  union all select doc_id, place, 1, case when sec = 'i' then 'ingredient' else 'step' end, clean from kinds where sec = 'i' or sec = 's' and num
  union all select doc_id, place, generate_subscripts(good, 1), 'step', unnest(good) from kinds where sec = 's' and not num
  union all select doc_id, place, 1, 'ingredient', clean from kinds where sec is null and (regexp_matches(bare, '^[-*•]\s') or {X.likely_ingredient(DUCK, 'clean')})
  union all select doc_id, place, 1, 'step', clean from kinds where sec is null and num and not (regexp_matches(bare, '^[-*•]\s') or {X.likely_ingredient(DUCK, 'clean')})
  union all select doc_id, place, generate_subscripts(good, 1), 'step', unnest(good) from kinds where sec is null and not num and not (regexp_matches(bare, '^[-*•]\s') or {X.likely_ingredient(DUCK, 'clean')}) and length(clean) > 20)
select doc_id, row_number() over (partition by doc_id order by place, k) as place, kind, text from rows""",
    "t2_split_blob": f"select p_partkey, concat_ws('|', {', '.join(_BLOB_PIECES)}) as pieces from part",
    "q7_step_timers": rf"""with b0 as (select doc_id, {_TIMED} as said, regexp_replace(regexp_replace(regexp_replace({_TIMED}, '(?i)about(\s)', '     \1', 'g'), '(?i)around(\s)', '      \1', 'g'), '(?i)approximately(\s)', '             \1', 'g') as t from documents),
{", ".join(_time_phase(k, *p) for k, p in enumerate(_PHASES))}
select doc_id, seconds, substr(said, start::bigint + 1, length(m)) as label, start::bigint as start, start::bigint + length(m) as stop from (select * from h0 union all select * from h1 union all select * from h2) h where seconds > 0""",
    "x15_post_texts": "select doc_id, case when doc_id % 3 = 0 then 'so' || chr(10) || 'é ' || repeat('good ', 10) || doc_id else 'ab ' || text || repeat('x', 100) end as post from documents",
    "x23_search_results": """with p as (select page_id, regexp_extract(html, '<title>([A-Za-z]*)', 1) as w from pages),
results as (select page_id, k, case when k % 5 = 1 then 'https://www.b.example/' || k else 'https://a.example/' || k || '?q=1' end as url, trim('T' || k || ' & ' || w) as title, regexp_replace('S ' || repeat(w || ' ', k * 5) || 'end', '\\s+', ' ', 'g') as snippet,
  case when k % 3 = 0 then 'shown' || k || '.example' when k % 5 = 1 then 'b.example' else 'a.example' end as site from p, (select unnest(range(25)) as k) n where page_id % 2 = 0 and k % 4 <> 0 and k <> 9 and not (k % 7 = 2 and k % 5 <> 1)
  union all select page_id, k, 'http://www.c.example/' || k, trim('R' || k || ' ' || w), trim('about ' || w), 'c.example' from p, (select unnest(range(20)) as k) n where page_id % 2 = 1 and k % 5 <> 2)
select page_id, row_number() over (partition by page_id order by k) as place, url, title, snippet[1:200] as snippet, site from results qualify place <= 12""",
}
for _name, _seconds, _most, *_keys in (("r2_rate_counts", 600, 1, "event_type", "user_id"), ("r3_daily_ceiling", 86400, 40, "event_type"), ("r7_event_counts", 3600, None, "event_type")):
    QUERIES[_name], ORACLE_SQL[_name] = _counts(_seconds, _most, *_keys)
