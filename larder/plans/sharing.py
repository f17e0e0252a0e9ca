"""Queries that write recipes out (JSON-LD, sitemap, Markdown) and read stored answers and captions in."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import text as T
from larder.functions.dialect import SPARK
from larder.operators import cards as C
from larder.operators import pages as Pages
from larder.operators import posts as P
from larder.operators.entities import decode

from . import scalars
from .bindings import bound, with_tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def project(name: str, *args, **more) -> None:
    scalars.project(name, *args, **more)
    QUERIES[name], ORACLE_SQL[name] = scalars.QUERIES.pop(name), scalars.ORACLE_SQL.pop(name)


def xml(x: str) -> str:
    for c, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        x = f"replace({x}, '{c}', '&{name};')"
    return x


#: The counts before a caption, and calls to comment or follow, which go.
COUNTS = r"^[0-9.,KMB]+\s*likes?,?\s*[0-9.,KMB]+\s*comments?\s*-\s*[A-Za-z0-9_]+\s+on\s+[^:]+:\s*\x22?"
CALLS = (r"\bcomment\s+[A-Za-z0-9_]+\s+and\s+I['’]ll\b.*$", r"\bcomment\s+[A-Za-z0-9_]+\b.*send\b.*$", r"^follow\s+(?:for|me)\b.*$")


def _lines(d) -> str:
    """Flags of a pattern over lines that end with a line feed only."""
    return "(?dmi)" if d.name == "spark" else "(?mi)"


def _folded(d, text: str) -> str:
    return d.replace(d.replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$")


def meta_caption(d, description: str) -> str:
    """A page's description, already decoded, without counts, quotes, hashtags and calls; null where nothing is left."""
    x = f"replace({description}, {d.text(chr(92) + 'n')}, chr(10))"
    for gone in (COUNTS, r"\x22\s*\.?\s*$", "#[A-Za-z0-9_]+", *(_lines(d) + c for c in CALLS)):
        x = d.replace(x, gone)
    return f"nullif({_folded(d, x)}, '')"


def embed_caption(d, block: str) -> str:
    """What stands in an embed's caption block, with line ends for breaks and ends of blocks; references are still in it."""
    x = block
    for gone, to in ((r"(?is)<a[^>]*class=\x22CaptionUsername\x22[^>]*>.*?</a>", ""), (r"(?i)<a[^>]*>#[A-Za-z0-9_]+</a>", ""), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(?:p|div|li)>", "\n"), (r"<[^>]+>", ""), ("&nbsp;", " ")):
        x = d.replace(x, gone, to)
    return x


def cleaned_embed(d, text: str) -> str:
    """An embed's caption, decoded, without lines that are a hashtag, a call or pictures."""
    x = text
    for gone in (r"^#[A-Za-z0-9_]+\s*$", CALLS[-1], rf"^[\s{T.PICTURES}]+$"):
        x = d.replace(x, _lines(d) + gone)
    return _folded(d, x)


CAPTION_BLOCK = (r'(?s)<div[^>]*class="Caption"[^>]*>(.*?)<div[^>]*class="CaptionComments"', r'(?s)<div[^>]*class="Caption"[^>]*>(.*?)</div>')
_META = """concat(case page_id % 3 when 0 then '<meta name="x" property="og:description" content="' else '<meta content="' end, '80K likes, 1,204 comments - cook_1 on May 1, 2024: &quot;Bean soup ', page_id, ' #yum &amp; more&#33;\\\\nfollow me now\\\\n\\\\n\\\\nStir it&quot;.',
case page_id % 3 when 0 then '">' else '" property="og:description">' end, html)"""
_EMBED = """concat('<div id="a" class="Caption"><a class="CaptionUsername" href="u">cook</a><br/>Pie &frac12; ', page_id, '<br><a href="t">#pie</a> <p>Mix &lt;it&gt;</p>#only<br>Follow for more pies<br>😀 🍲<br>', url, case when page_id % 2 = 0 then '<div class="CaptionComments">no</div></div>' else '</div><div>no</div>' end, html)"""


def x18_meta_caption(spark, sf_dir):
    """Captions by the page's description and by the embed's block."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.expr(_META).alias("meta"), F.expr(_EMBED).alias("embed"))
    described = F.coalesce(*[F.nullif(F.regexp_extract("meta", p, 1), F.lit("")) for p in (r'<meta[^>]*property="og:description"[^>]*content="([^"]*)"', r'<meta[^>]*content="([^"]*)"[^>]*property="og:description"')])
    block = F.coalesce(*[F.nullif(F.regexp_extract("embed", p, 1), F.lit("")) for p in CAPTION_BLOCK])
    read = pages.select("page_id", decode(described).alias("meta"), block.alias("block")).withColumn("embed", F.expr(embed_caption(SPARK, "block"))).withColumn("embed", decode(F.col("embed")))
    return read.select("page_id", F.expr(meta_caption(SPARK, "meta")).alias("caption"), F.expr(cleaned_embed(SPARK, "embed")).alias("embed"))


def picked_image(d, html: str) -> str:
    """The image that a page's data names, else its og:image in either order of attributes."""
    ways = (r'"image"\s*:\s*\[?\s*"([^"]+)"', r'"image"\s*:\s*\[?\s*\{[^}]*"(?:url|contentUrl)"\s*:\s*"([^"]+)"', r'<meta property="og:image" content="([^"]+)"', r'<meta content="([^"]+)" property="og:image"')
    return "coalesce(" + ", ".join(f"nullif({d.extract(html, w)}, '')" for w in ways) + ")"


def sentence_steps(d, t: str) -> str:
    """T5: sentences that hold a cooking verb."""
    return d.filter(T.sentences(d, t), "s", T.has_verb(d, "s"))


project("s11_sitemap", "pages", "page_id", lambda d: {"line": f"concat('<url><loc>', {xml('url')}, '</loc></url>')"}, where=lambda d: d.like("url", "^https?:"))
project("x8_pick_image", "pages", "page_id", lambda d: {"image": picked_image(d, "h")}, prepare="""select page_id, concat(case page_id % 4 when 0 then '{"image": ["https://i/a.png"]}' when 1 then '{"image": {"@type": "x", "url": "https://i/b.png"}}' when 2 then '<meta content="https://i/c.png" property="og:image">' else '' end, html) as h""")
project("t5_sentence_steps", "documents", "doc_id", lambda d: {"steps": d.join(sentence_steps(d, "t"), "|")}, prepare="select doc_id, concat(text, '. Stir the soup. It is good. 2. Serve it hot.') as t")
project("x25_legacy_recipe", "orders", "o_orderkey", lambda d: {"steps": d.join(d.filter(d.map(d.split("s", "\\n"), "p", T.strip_number(d, "p")), "p", "p <> ''"), "|")}, prepare=lambda d: f"select o_orderkey, concat('1. Chop', chr(10), '2) Boil ', cast(o_orderkey % 9 as {d.text_type}), chr(10), chr(10), 'Step 3: Eat') as s")


def x27_model_recipe(spark, sf_dir):
    """Stored model answers: from the first brace to the last; errors and parts missing reject a row."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    said = F.expr("""concat('Here it is: ', case o_orderkey % 4 when 0 then '{"error": "no"}' when 1 then concat('{"title": "R', o_orderkey, '", "ingredients": ["a"], "steps": []}') when 2 then '{"title": "x"}' else '{broken' end, ' Enjoy!')""")
    v = F.try_parse_json(F.regexp_extract(said, r"(?s)\{.*\}", 0))
    fine = "try_variant_get(v, '$.error', 'variant') is null and try_variant_get(v, '$.ingredients', 'array<variant>') is not null and try_variant_get(v, '$.steps', 'array<variant>') is not null"
    return orders.select("o_orderkey", v.alias("v")).where(fine).select("o_orderkey", F.expr("try_variant_get(v, '$.title', 'string')").alias("title")).where("title is not null")


def x17_short_video_caption(spark, sf_dir):
    """The longest description of 50 characters or more in a page's data, else its og:description."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = F.expr("""concat('{"desc": "short"},', case when page_id % 3 = 0 then concat('<meta property="og:description" content="pie ', page_id, '">') else concat('{"desc": "', repeat('soup ', 12), page_id, '"},{"desc": "', repeat('pie ', 14), '"}') end, html)""")
    return pages.select("page_id", P.short_video_caption(html).alias("caption"))


def p13_valid_normalized(spark, sf_dir):
    """Entries of stored name lists with text, name and a known action; grams as numbers."""
    docs = spark.read.parquet(f"{sf_dir}/orders.parquet")
    said = F.expr("""concat('```json\n[{"raw": "a', o_orderkey, '", "name": "n", "action": "', case o_orderkey % 3 when 0 then 'MATCH' when 1 then 'SKIP' else 'EAT' end, '", "defaultGrams": "', o_orderkey % 90, '"}, {"raw": "b"}]\n```')""")
    plain = F.regexp_replace(said, r"```(?:json)?", "")
    rows = docs.select("o_orderkey", F.explode(F.from_json(plain, "array<struct<raw:string,name:string,action:string,defaultGrams:string>>")).alias("e"))
    return rows.where("e.raw is not null and e.name is not null and e.action in ('MATCH', 'SKIP', 'ESTIMATE_QUANTITY')").select("o_orderkey", "e.raw", "e.action", F.expr("try_cast(e.defaultGrams as double)").alias("grams"))


#: JSON-LD with a rating, broken JSON-LD with a picture of the page, and none, before the real page.
_RATED = """concat(case page_id % 3 when 0 then concat('<script type="application/ld+json">{"@graph": [{"@type": "Recipe", "image": [{"url": "https://i/', page_id, '.png"}], "aggregateRating": {"ratingValue": "', page_id % 5, '.5", "reviewCount": ', page_id % 90, '}}]}</script>')
when 1 then concat('<script type="application/ld+json">{"@type": "Recipe", }</script><meta property="og:image" content="https://og/', page_id, '.png">') else '' end, html)"""


def j11_enrich_results(spark, sf_dir):
    """Search results with picture and rating of their pages, read from the pages; results without a page stay."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    results = pages.select(F.col("page_id").alias("result"), F.when(F.col("page_id") % 4 != 0, F.col("url")).otherwise(F.lit("https://none.example/")).alias("url"))
    return Pages.enriched(results, pages.select("url", "page_id", F.expr(_RATED).alias("html"))).select("result", "image", "rating", "rating_count")


#: Recipes with all that a card tells, made of the bound tables: {names} is the list of a recipe's lines, in both engines.
_FACTS = {
    "author": "case when recipe_id % 5 > 0 then concat('Cook ', cast(user_id as varchar(20))) end",
    "image_url": "case recipe_id % 4 when 0 then 'javascript:x' when 1 then concat('https://i.example/', cast(recipe_id as varchar(20)), '.png') end",
    "prep_minutes": "cast(recipe_id % 70 as bigint)",
    "cook_minutes": "cast(case when recipe_id % 8 = 0 then 0 else recipe_id % 150 end as bigint)",
    "total_minutes": "cast(case when recipe_id % 3 = 0 then null else recipe_id % 200 end as bigint)",
}


def _cards(spark, sf_dir):
    lines = bound(spark, sf_dir, "lines")
    own = lines.groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "part_no", "supp_no", "name", "unit"))).alias("l"))
    recipes = bound(spark, sf_dir, "recipes").join(own, "recipe_id").withColumn("names", F.transform("l", lambda x: x["name"]))
    told = recipes.withColumns({c: F.expr(e) for c, e in _FACTS.items()}).withColumns(
        {
            "ingredients": F.transform("l", lambda x: F.concat(F.lit("1/2 "), F.coalesce(F.concat(x["unit"], F.lit(" ")), F.lit("")), x["name"], F.lit(", cut ($1.50)"))),
            "steps": F.when(F.col("recipe_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.transform("names", lambda n: F.concat(F.lit("Mix the "), n))),
            "keywords": F.array("tag", "category"),
            "categories": F.when(F.col("recipe_id") % 6 > 0, F.array("category")).otherwise(F.array().cast("array<string>")),
            "cuisines": F.when(F.col("recipe_id") % 10 == 0, F.array(F.lit("Thai"), F.lit("Lao"))),
            "nutrition": F.when(F.col("declared_calories").isNotNull(), F.struct(F.col("declared_calories").cast("double").alias("calories"), (F.col("recipe_id") % 9 + 0.5).cast("double").alias("fat_g"), F.lit(None).cast("double").alias("sugar_g"))),
        }
    )
    return told


def s12_markdown(spark, sf_dir):
    cards = _cards(spark, sf_dir)
    return cards.select("recipe_id", C.markdown(cards, F.concat(F.lit("https://larder.example/r#"), F.col("recipe_id").cast("string")), "View with cooking mode").alias("markdown"))


def s10_schema_org(spark, sf_dir):
    cards = C.described(_cards(spark, sf_dir))
    return cards.select("recipe_id", C.schema_org(cards, "https://larder.example/card.png").alias("card"))


def d6_share_description(spark, sf_dir):
    return C.described(_cards(spark, sf_dir)).select("recipe_id", "description")


def s2_import_library(spark, sf_dir):
    """Envelopes of recipes and bare recipes, as JSON texts, to recipe rows; other texts give none."""
    docs = spark.read.parquet(f"{sf_dir}/orders.parquet")
    said = F.expr("""case o_orderkey % 3 when 0 then concat('{"version": 1, "recipes": [{"title": "A', o_orderkey, '", "ingredients": ["x"]}, {"title": "B", "ingredients": []}]}') when 1 then concat('{"title": "C', o_orderkey, '", "ingredients": ["y"]}') else '{"other": 1}' end""")
    shape = "struct<title:string,ingredients:array<string>>"
    many = F.from_json(said, f"recipes array<{shape}>")["recipes"]
    one = F.from_json(said, "title string, ingredients array<string>")
    rows = docs.select("o_orderkey", F.explode(F.coalesce(many, F.array(F.struct(one["title"].alias("title"), one["ingredients"].alias("ingredients"))))).alias("r"))
    return rows.where("r.title is not null and r.ingredients is not null").select(F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "r.title"), 256).alias("id"), "r.title")


def s4_export_library(spark, sf_dir):
    """One envelope per user, recipes in order of their ids."""
    recipe = F.struct("recipe_id", "title", F.col("source_url").alias("url"))
    users = bound(spark, sf_dir, "recipes").groupBy("user_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(recipe)).alias("r"))
    return users.select("user_id", F.to_json(F.struct(F.lit(1).alias("version"), F.col("n").alias("recipeCount"), F.transform("r", lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"))).alias("recipes"))).alias("envelope"))


QUERIES |= {f.__name__: f for f in (x18_meta_caption, s4_export_library, x27_model_recipe, x17_short_video_caption, p13_valid_normalized, j11_enrich_results, s12_markdown, s10_schema_org, d6_share_description, s2_import_library)}
_SPOKEN = lambda m, minute="m": f"case when {m} > 0 then case when {m} < 60 then {m} || '{minute}' when {m} % 60 = 0 then ({m} // 60) || 'h' else ({m} // 60) || 'h ' || ({m} % 60) || 'm' end end"
_ISO = lambda m: f"case when {m} > 0 then 'PT' || case when {m} >= 60 then ({m} // 60) || 'H' else '' end || case when {m} % 60 > 0 then ({m} % 60) || 'M' else '' end end"
_SOME = lambda x: f"case when len({x}) > 0 then {x} end"
#: Cards of the same recipes: lines are joined with what they are known to be made of, names need no pattern.
_CARDS = f"""--and listed as (select r.*, l.names, l.ls, l.told, {", ".join(f"{e} as {c}" for c, e in _FACTS.items())} from recipes r join (select recipe_id as rid, list(name order by line_no, part_no, supp_no) as names,
  list('1/2 ' || coalesce(unit || ' ', '') || name || ', cut' order by line_no, part_no, supp_no) as ls,
  list(case when unit in ('kilogram', 'milliliter', 'bunch') then unit || ' ' else '' end || name order by line_no, part_no, supp_no) as told from lines group by recipe_id) l on r.recipe_id = rid),
named as (select *,
  case when recipe_id % 11 = 0 then [] else list_transform(names, lambda n: 'Mix the ' || n) end as steps, case when recipe_id % 6 > 0 then [category] else [] end as cats, case when recipe_id % 10 = 0 then ['Thai', 'Lao'] else [] end as cuis from listed),
said as (select *, list_filter([array_to_string(told[1:3], ', ') || case when len(told) > 3 then ', and ' || (len(told) - 3) || ' more' else '' end,
  concat_ws(', ', coalesce('ready in ' || {_SPOKEN('total_minutes')}, {_SPOKEN('cook_minutes')} || ' cook time'), 'serves ' || servings, case when len(steps) > 0 then len(steps) || ' step' || case when len(steps) = 1 then '' else 's' end end),
  lower(array_to_string(cats, ', ')), lower(array_to_string(cuis, ', '))], lambda p: p <> '') as parts from named),
plain as (select *, array_to_string(list_transform(parts, lambda p: upper(p[1]) || p[2:]), '. ') || '.' as d from said),
filled as (select *, case when length(d) >= 80 then d when length(d) <= 125 - 72 then d || ' Just the recipe: clean ingredients and steps, no ads and no life story.' when length(d) <= 125 - 41 then d || ' Just the recipe — no ads, no life story.' else d end as f from plain),
cards as (select *, case when length(f) > 125 then regexp_replace(f[1:124], '\\s+\\S*$', '') || '…' else f end as description from filled) """
ORACLE_SQL |= {
    "x18_meta_caption": "select page_id, 'Bean soup ' || page_id || '  & more!' || chr(10) || chr(10) || 'Stir it' as caption, 'Pie ½ ' || page_id || chr(10) || ' Mix <it>' || chr(10) || chr(10) || url as embed from pages",
    "s4_export_library": with_tables("select user_id, cast(json_object('version', 1, 'recipeCount', count(*), 'recipes', list(json_object('title', title, 'url', source_url) order by recipe_id)) as varchar) as envelope from recipes group by user_id", "recipes"),
    "x27_model_recipe": "select o_orderkey, 'R' || o_orderkey as title from orders where o_orderkey % 4 = 1",
    "x17_short_video_caption": "select page_id, case when page_id % 3 = 0 then 'pie ' else repeat('soup ', 12) end || page_id as caption from pages",
    "p13_valid_normalized": "select o_orderkey, 'a' || o_orderkey as raw, case o_orderkey % 3 when 0 then 'MATCH' else 'SKIP' end as action, cast(o_orderkey % 90 as double) as grams from orders where o_orderkey % 3 < 2",
    "j11_enrich_results": """select p.page_id as result, case first % 3 when 0 then 'https://i/' || first || '.png' when 1 then 'https://og/' || first || '.png' else nullif(regexp_extract(f.html, '<meta[^>]*property="og:image"[^>]*content="([^"]+)"', 1), '') end as image,
case when first % 3 = 0 then (first % 5 + 0.5)::double end as rating, case when first % 3 = 0 then nullif(first % 90, 0)::bigint end as rating_count
from pages p left join (select url, min(page_id) as first, arg_min(html, page_id) as html from pages group by url) f on p.url = f.url and p.page_id % 4 <> 0""",
    "s12_markdown": with_tables(
        _CARDS
        + f"""select recipe_id, concat_ws(chr(10), '**' || title || '**' || chr(10), nullif(concat_ws(' | ', 'Serves ' || servings, 'Prep: ' || {_SPOKEN('prep_minutes', ' min')}, 'Cook: ' || {_SPOKEN('cook_minutes', ' min')},
  case when prep_minutes = 0 and cook_minutes = 0 then 'Total: ' || {_SPOKEN('total_minutes', ' min')} end), '') || chr(10), '**Ingredients**', '', array_to_string(list_transform(ls, lambda n: '* ' || n || ' ($1.50)'), chr(10)), '',
  case when len(steps) > 0 then concat_ws(chr(10), '**Instructions**', '', array_to_string(list_transform(steps, lambda x, i: i || '. ' || x), chr(10)), '') end, '---', '', '[View with cooking mode](https://larder.example/r#' || recipe_id || ')') as markdown from cards""",
        "recipes",
        "lines",
    ),
    "s10_schema_org": with_tables(
        _CARDS
        + f"""select recipe_id, json_merge_patch('{{}}', json_object('@context', 'https://schema.org', '@type', 'Recipe', 'name', title, 'description', description, 'image', case when recipe_id % 4 = 1 then image_url else 'https://larder.example/card.png' end,
  'author', case when author is not null then json_object('@type', 'Person', 'name', author) end, 'recipeYield', servings::varchar, 'prepTime', {_ISO('prep_minutes')}, 'cookTime', {_ISO('cook_minutes')}, 'totalTime', {_ISO('total_minutes')}, 'keywords', tag || ', ' || category,
  'recipeCuisine', {_SOME('cuis')}, 'recipeCategory', {_SOME('cats')}, 'recipeIngredient', ls, 'recipeInstructions', case when len(steps) > 0 then [json_object('@type', 'HowToSection', 'name', 'Instructions', 'numberOfItems', len(steps))] end,
  'nutrition', case when declared_calories is not null then json_object('@type', 'NutritionInformation', 'calories', declared_calories || ' calories', 'fatContent', (recipe_id % 9) || '.5 g') end, 'url', nullif(source_url, '')))::varchar as card from cards""",
        "recipes",
        "lines",
    ),
    "d6_share_description": with_tables(_CARDS + "select recipe_id, description from cards", "recipes", "lines"),
    "s2_import_library": "select sha256(o_orderkey || '|' || title) as id, title from (select o_orderkey, unnest(case o_orderkey % 3 when 0 then ['A' || o_orderkey, 'B'] else ['C' || o_orderkey] end) as title from orders where o_orderkey % 3 < 2) q",
}
