"""Queries that apply text, time and URL scalars to whole tables; nothing is shuffled."""

from __future__ import annotations

from larder.functions import text as T
from larder.functions.dialect import DUCK, SPARK

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def project(name: str, table: str, keys: str, build, where=None, prepare: str = "select *") -> None:
    """Registers a projection of a given table: build(d, ...) gives {column: expression}."""

    def text(d) -> str:
        columns = ", ".join(f"{e} as {n}" for n, e in build(d).items())
        inner = (prepare(d) if callable(prepare) else prepare) + " from " + ("{t}" if d is SPARK else table)
        out = f"select {keys}, {columns} from ({inner}) q" + (f" where {where(d)}" if where else "")
        return out.replace("{", "{{").replace("}", "}}").replace("{{t}}", "{t}") if d is SPARK else out

    def query(spark, sf_dir):
        return spark.sql(text(SPARK), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    QUERIES[name], ORACLE_SQL[name] = query, text(DUCK)


PAGE = "page_id"
project("p1_route_url", "pages", PAGE, lambda d: {"route": T.route(d, "u")}, prepare="select page_id, case page_id % 6 when 0 then 'https://www.tiktok.com/@a/video/1' when 1 then concat(url, '/a.jpg') when 2 then 'https://youtu.be/abcdefghijk' when 3 then 'https://www.instagram.com/reel/Xy_1/' else url end as u")
project("p3_block_page", "pages", PAGE, lambda d: {"blocked": T.is_block_page(d, "html")})
project("p4_unsafe_url", "pages", PAGE, lambda d: {"unsafe": T.is_unsafe(d, "u")}, prepare="select page_id, case page_id % 5 when 0 then 'http://127.0.0.1/x' when 1 then 'ftp://a.example.com/' when 2 then 'http://172.20.1.1/' else url end as u")
project("p5_page_has_recipe", "pages", PAGE, lambda d: {"found": T.page_has_recipe(d, "h")}, prepare="""select page_id, concat(html, case page_id % 3 when 0 then '<script>{"@type": "Recipe"}</script>' when 1 then '<h2>Ingredients</h2><h3>Directions</h3>' else '' end) as h""")
project("p6_post_ids", "pages", PAGE, lambda d: {"video": T.video_id(d, "v"), "code": T.shortcode(d, "i"), "embed": T.embed_url(d, "i")}, prepare="select page_id, concat('https://www.youtube.com/watch?v=', substring(md5(url), 1, 11)) as v, case when page_id % 2 = 0 then concat('https://www.instagram.com/p/', substring(md5(url), 1, 9), '/') else url end as i")
project("p7_canonical_url", "pages", PAGE, lambda d: {"canonical": T.canonical_url(d, "url")})
project("p8_source_domain", "pages", PAGE, lambda d: {"domain": T.source_domain(d, "url")})
project("p10_instruction_step", "documents", "doc_id", lambda d: {"kept": T.is_instruction(d, "t")}, prepare="select doc_id, case doc_id % 4 when 0 then concat('Note: ', text) when 1 then 'Serve immediately with rice' when 2 then 'ok' else text end as t")
project("p11_not_ad_text", "documents", "doc_id, n_chars", lambda d: {"one": "1"}, where=lambda d: f"not {T.is_ad(d, 't')}", prepare="select doc_id, n_chars, case when doc_id % 5 = 0 then concat(text, ' adsbygoogle ') else text end as t")
project("p14_http_only", "pages", PAGE, lambda d: {"safe": T.http_only(d, "u")}, prepare="select page_id, case when page_id % 2 = 0 then concat('data:', url) else url end as u")
project("p15_first_url", "pages", PAGE, lambda d: {"found": T.first_url(d, "t")}, prepare="select page_id, concat('look at ', url, ' and more') as t")
project("d1_iso_minutes", "orders", "o_orderkey", lambda d: {"minutes": T.iso_minutes(d, "s")}, prepare=lambda d: f"select o_orderkey, concat('P', case when o_orderkey % 11 = 0 then '1D' else '' end, 'T', case when o_orderkey % 3 = 0 then concat(cast(o_orderkey % 5 as {d.text_type}), 'H') else '' end, cast(o_orderkey % 60 as {d.text_type}), 'M', case when o_orderkey % 7 = 0 then '45S' else '' end) as s")
project("d2_informal_minutes", "orders", "o_orderkey", lambda d: {"minutes": T.informal_minutes(d, "s")}, prepare=lambda d: f"select o_orderkey, case o_orderkey % 4 when 0 then concat(cast(o_orderkey % 9 as {d.text_type}), '.5 hrs ', cast(o_orderkey % 50 as {d.text_type}), ' min') when 1 then cast(o_orderkey % 90 as {d.text_type}) when 2 then 'a while' else concat(cast(o_orderkey % 9 as {d.text_type}), ' Hours') end as s")
project("d3_week_start", "orders", "o_orderkey", lambda d: {"week": "cast(date_trunc('week', o_orderdate) as date)", "next_week": "cast(date_trunc('week', o_orderdate) as date) + " + ("7" if d.name == "duck" else "interval 7 days")})
project("d4_day_code", "orders", "o_orderkey", lambda d: {"day": "case " + ("dayofweek(o_orderdate) - 1" if d.name == "spark" else "dayofweek(o_orderdate)") + " when 0 then 'sun' when 1 then 'mon' when 2 then 'tue' when 3 then 'wed' when 4 then 'thu' when 5 then 'fri' else 'sat' end", "label": ("concat(date_format(date_trunc('week', o_orderdate), \"'Week of' MMM d\"), date_format(date_trunc('week', o_orderdate) + interval 6 days, \"' - 'MMM d\"))" if d.name == "spark" else "strftime(date_trunc('week', o_orderdate), 'Week of %b %-d') || strftime(date_trunc('week', o_orderdate) + interval 6 day, ' - %b %-d')")})
project("d5_strip_cost", "part", "p_partkey", lambda d: {"plain": T.strip_cost(d, "s")}, prepare=lambda d: f"select p_partkey, concat('2 cups ', p_name, ' ($', cast(p_partkey % 9 as {d.text_type}), '.50)') as s")
project("d8_client_ip", "events", "event_id", lambda d: {"ip": T.client_ip(d, "h", "p")}, prepare=lambda d: f"select event_id, case when event_id % 3 = 0 then concat(' 10.0.0.', cast(user_id % 250 as {d.text_type}), ' , 1.1.1.1') when event_id % 3 = 1 then '' end as h, case when event_id % 2 = 0 then '9.9.9.9' end as p")
project("d10_clean_food_name", "part", "p_partkey", lambda d: {"food": T.clean_food_name(d, "s")}, prepare="select p_partkey, concat(' ', p_name, case p_partkey % 3 when 0 then ' (ripe), sliced' when 1 then ' / other' else '' end) as s")
project("d11_affiliate_url", "pages", PAGE, lambda d: {"link": T.affiliate(d, "url")})
project("x7_servings", "orders", "o_orderkey", lambda d: {"n": T.servings(d, "s")}, prepare=lambda d: f"select o_orderkey, case when o_orderkey % 5 = 0 then 'a crowd' else concat('Serves ', cast(o_orderkey % 12 as {d.text_type}), ' to 20') end as s")
project("x10_sentences", "documents", "doc_id", lambda d: {"n": d.size(T.sentences(d, "text")), "joined": d.join(T.sentences(d, "text"), "|")})
project("x11_source_nutrition", "orders", "o_orderkey", lambda d: {"kcal": T.leading_number(d, "s")}, prepare=lambda d: f"select o_orderkey, case when o_orderkey % 6 = 0 then 'none' else concat(' ', cast(o_orderkey % 800 as {d.text_type}), '.5 calories') end as s")
project("x12_string_list", "orders", "o_orderkey", lambda d: {"words": d.join(T.string_list(d, "s"), "|")}, prepare="select o_orderkey, concat(o_orderpriority, ', ,', o_orderstatus, ' , ') as s")
project("x13_auto_tag", "orders", "o_orderkey", lambda d: {"tags": T.auto_tags(d, "o_orderpriority", "s")}, prepare="select o_orderkey, o_orderpriority, case o_orderkey % 5 when 0 then 'Quick dinner' when 1 then 'Cheesecake' when 2 then 'Light lunch' else 'Soup' end as s")
_CAPTION = ["#yum #food", "Follow me for more! end", "you should Comment SOUP and I'll send it", "x comment recipe, and I send", "𝐅𝐨𝐥𝐥𝐨𝐰 all", "😀 🍲", "•••───", "== a ==", "", "", "", "end"]
project("x19_clean_caption", "documents", "doc_id", lambda d: {"clean": T.clean_caption(d, "t")}, prepare="select doc_id, concat_ws(chr(10), text, " + ", ".join("'" + c.replace("'", "’") + "'" for c in _CAPTION) + ") as t")
project(
    "t3_likely_ingredient",
    "documents",
    "doc_id",
    lambda d: {"likely": T.likely_ingredient(d, "t")},
    prepare="select doc_id, case doc_id % 8 when 0 then '2 cups rice' when 1 then '1/2 yellow onion' when 2 then '3 tomatoes' when 3 then 'Salt and pepper, to taste' when 4 then '1lb chicken' when 5 then '3 stir the pot' else text end as t",
)
project("t4_cooking_verb", "documents", "doc_id", lambda d: {"verb": T.has_verb(d, "t"), "step": T.reads_like_step(d, "t")}, prepare="select doc_id, case when doc_id % 3 = 0 then concat(text, ' stir well') else text end as t")
project("q8_primary_timer", "orders", "o_orderkey", lambda d: {"seconds": T.primary_timer(d, "s")}, prepare=lambda d: f"select o_orderkey, case o_orderkey % 4 when 0 then concat('Bake 10-', cast(o_orderkey % 40 as {d.text_type}), ' minutes, rest 90 seconds') when 1 then 'Chill 2 hours and 15 minutes, then 30 mins' when 2 then 'Eat' else concat('about ', cast(o_orderkey % 7 as {d.text_type}), ' hrs') end as s")
project("s4_recipe_slug", "part", "p_partkey", lambda d: {"slug": T.slug(d, "p_name")})
