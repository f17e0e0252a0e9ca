"""Queries that read recipes from pages with a recipe built in, whose parts are known to the SQL."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from larder.functions import text as T
from larder.functions.dialect import DUCK, SPARK
from larder.operators import pages as P
from larder.operators.entities import decode
from larder.sources import payloads as S

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: Words of the page itself, of which its recipe is built, so that parts and their number differ by page.
WORDS = "slice(regexp_extract_all(html, '[A-Za-z]{4,}', 0), 1, cast(page_id % 4 as int) + 1)"
_each = lambda before, after, by="": f"array_join(transform(w, x -> concat('{before}', x, '{after}')), '{by}')"
JSON_ITEMS, JSON_STEPS = _each('"2 cups ', '"', ", "), _each('{"@type": "HowToStep", "text": "Mix the ', '"}', ", ")
JSONLD = f"""concat('<script type="application/ld+json">{{"@graph": [{{"@type": "WebPage"}}, {{"@type": ["Recipe"], "name": "Recipe ', n, ' &amp; more", "author": [{{"name": "', w[0], '"}}], "image": [{{"url": "https://i/', n, '.png"}}],
"recipeYield": ["', page_id % 9 + 1, ' servings"], "prepTime": "PT', page_id % 50, 'M", "cookTime": "PT1H', page_id % 7, 'M", "keywords": "', array_join(w, ', '), ', ", "recipeCategory": ["Dinner"], "nutrition": {{"calories": "', page_id % 700, '.5 kcal", "fatContent": 3}},
"recipeIngredient": [', {JSON_ITEMS}, ', " "], "recipeInstructions": [', {JSON_STEPS}, ', "Tip: chill"]}}]}}</script>')"""
MICRODATA = f"""concat('<div itemscope itemtype="https://schema.org/Recipe"><h2 itemprop="name">Recipe ', n, ' &amp; more</h2><div><p itemprop="author" itemscope itemtype="https://schema.org/Person">by <b itemprop="name">', w[0], '</b></div>
<img itemprop="image" src="https://i/', n, '.png"><meta itemprop="recipeYield" content="', page_id % 9 + 1, ' servings"><time itemprop="prepTime" datetime="PT', page_id % 50, 'M">a while</time><time itemprop="cookTime">PT1H', page_id % 7, 'M</time>
<div itemprop="nutrition" itemscope><i itemprop="calories">', page_id % 700, '.5 kcal</i><i itemprop="fatContent">3 g</i></div><ul>', {_each('<li itemprop="recipeIngredient">2 <b>cups</b> ', '')}, '</ul>', {_each('<div itemprop="recipeInstructions">Mix the ', '</div>')}, '<p itemprop="recipeInstructions">Tip: chill</p></div>')"""
HEADINGS = f"""concat('<h1>Recipe ', n, ' &amp; more</h1><meta property="og:image" content="https://i/', n, '.png"><h2>Ingredients</h2><p>for four<ul>', {_each('<li>2 cups ', '')}, '</ul><h2>Directions</h2><h3>1. Dough</h3><p>', {_each('Mix the ', '', '<br>')}, '</p><h3>2. End</h3><ul><li>Tip: chill</ul><h4>Notes</h4><p>Mix no more</p><h2>x</h2>')"""

#: JSON-LD that is no JSON before microdata that is good; and instructions as one string, without ingredients, and in a section.
BROKEN = "concat('<script type=\"application/ld+json\">{\"@type\": \"Recipe\", \"recipeIngredient\": [\"x\", }</script>', " + MICRODATA + ")"
STRING = f"""concat('<script type="application/ld+json">[{{"@type": "Recipe", "name": "Empty"}}, {{"@type": "https://schema.org/Recipe", "name": "Recipe ', n, ' &amp; more", "author": "', w[0], '", "image": "https://i/', n, '.png", "recipeInstructions": "', {_each('Mix the ', '.', ' ')}, ' Serve immediately."}}]</script>')"""
SECTIONS = f"""concat('<script type="application/ld+json">{{"@type": "Recipe", "name": ["Recipe ', n, ' &amp; more"], "image": {{"contentUrl": "https://i/', n, '.png"}}, "recipeIngredient": [', {JSON_ITEMS}, '], "recipeInstructions": [{{"@type": "HowToSection", "name": "Dough", "itemListElement": [', {JSON_STEPS}, ', "The rest is easy"]}}, {{"@type": "HowToStep", "name": "Name alone"}}]}}</script>')"""
KINDS = (("jsonld", JSONLD), ("microdata", MICRODATA), ("heuristic", HEADINGS), ("microdata", BROKEN), ("jsonld", STRING), ("jsonld", SECTIONS))
#: Whole pages before references of each sort: known and unknown names, without a semicolon, numbers of either base.
REFERENCES = "concat(html, ' &eacute;&notit;&NotEqualTilde; &nosuch; &amp;lt; &ampx &#', page_id + 160, ';&#x1F600;&#X3bb &')"
PART = f"page_id % {len(KINDS)}"
RECIPE = f"case {PART} " + " ".join(f"when {k} then {text}" for k, (_, text) in enumerate(KINDS)) + " end"


def built(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("n", F.col("page_id").cast("string")).withColumn("w", F.expr(WORDS))
    return pages.select("page_id", "url", F.expr(f"concat({RECIPE}, html)").alias("html"))


LAYER = f"case {PART} " + " ".join(f"when {k} then '{layer}'" for k, (layer, _) in enumerate(KINDS)) + " end"


def x1_jsonld_blocks(spark, sf_dir):
    return P.jsonld_blocks(built(spark, sf_dir)).select("page_id", F.col("block").cast("long").alias("block"))


def x2_jsonld_recipes(spark, sf_dir):
    return P.jsonld_recipes(built(spark, sf_dir)).select("page_id", F.expr("coalesce(get_json_object(json, '$.name[0]'), get_json_object(json, '$.name'))").alias("title"))


def x3_microdata(spark, sf_dir):
    found = P.normalized(P.microdata_recipes(built(spark, sf_dir)))
    return found.select("page_id", F.col("item").cast("long").alias("item"), "title", "author", F.col("nutrition.fat_g").alias("fat_g"), F.array_join("ingredients", "|").alias("ingredients"), F.array_join("steps", "|").alias("steps"))


def x4_headings(spark, sf_dir):
    return P.normalized(P.heading_recipes(built(spark, sf_dir).where(f"{PART} = 2"))).select("page_id", "title", "image", F.array_join("ingredients", "|").alias("ingredients"), F.array_join("steps", "|").alias("steps"))


def x5_best_layer(spark, sf_dir):
    return P.best_layer(built(spark, sf_dir)).select("page_id", "layer", "title", F.array_join("ingredients", "|").alias("ingredients"), F.array_join("steps", "|").alias("steps"))


def x6_recipes(spark, sf_dir):
    best = P.best_layer(built(spark, sf_dir))
    return best.select(
        "page_id", "title", "author", "image", "servings_text", "servings", "prep_minutes", "cook_minutes", "total_minutes", F.col("nutrition.calories").alias("calories"), F.col("nutrition.fat_g").alias("fat_g"),
        F.col("nutrition.sugar_g").alias("sugar_g"), F.array_join("keywords", "|").alias("keywords"), F.array_join("categories", "|").alias("categories"), "tags", F.size("ingredients").cast("long").alias("n_ingredients"),
    )


def a12_extraction_quality(spark, sf_dir):
    read = P.best_layer(built(spark, sf_dir), "url").withColumn("domain", F.expr(T.source_domain(SPARK, "url")))
    found = P.extraction_quality(read, "domain")
    return found.select("domain", "layer", "n_recipes", F.round("share_timed", 4).alias("share_timed"), "n_lines", F.round("share_measured", 4).alias("share_measured"))


def x14_decode_entities(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("t", F.expr(REFERENCES))
    return pages.select("page_id", decode(F.col("t")).alias("plain"))


def x9_steps(spark, sf_dir):
    return P.steps(P.best_layer(built(spark, sf_dir))).select("page_id", F.col("ord").cast("long").alias("ord"), "text")


def _recipes(spark, sf_dir):
    """Whole texts as recipes: the text is the description, and its lines are the ingredients of every other one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = F.when(F.col("doc_id") % 2 == 0, F.split("text", "\n")).otherwise(F.array("source"))
    return docs.select("doc_id", F.concat(F.lit("Recipe "), F.col("doc_id").cast("string")).alias("title"), lines.alias("ingredients"), F.array(F.lit("Mix.")).alias("steps"), F.col("text").alias("description"), F.array("lang", "source").alias("keywords"), F.col("source").alias("author"))


#: Words of a text in one recipe, so that whole texts go through payloads of bounded size.
PIECE = 200


def _pieces(spark, sf_dir):
    words = _recipes(spark, sf_dir).withColumn("w", F.split("description", r"\s+"))
    cut = F.expr(f"transform(sequence(0, (size(w) - 1) div {PIECE}), k -> slice(w, k * {PIECE} + 1, {PIECE}))")
    return words.select("doc_id", "title", "steps", F.posexplode(cut).alias("piece", "ingredients"))


def s8_share_round_trip(spark, sf_dir):
    shared = S.decode_payloads(S.share_payloads(_pieces(spark, sf_dir)))
    return shared.select("doc_id", F.col("piece").cast("long").alias("piece"), F.col("recipe.t").alias("title"), F.array_join("recipe.ig", " ").alias("ingredients"))


def s15_fit_share_link(spark, sf_dir):
    """Both forms of every document's link: which fields go, and how long it is."""
    recipes = _recipes(spark, sf_dir)
    links = [S.fit_share_link(recipes, "https://larder.example/r#", short=short).select("doc_id", F.lit(short).alias("short"), "dropped", F.length("link").alias("size")) for short in (False, True)]
    return links[0].union(links[1])


def s14_import_inbox(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.to_json(F.struct(F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("title"), F.when(F.col("doc_id") % 3 == 0, F.lit("x")).alias("other")))
    sent = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "not base64!").otherwise(F.base64(text.cast("binary"))).alias("message"))
    return S.import_inbox(sent).select("doc_id", "title", "accepted")


def x22_chat_recipes(spark, sf_dir):
    chat = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    said = chat.withColumn("said", F.expr("""concat(text, case when conv_id % 2 = 0 then concat('\n```recipe-json\n{"title": "T', conv_id, '", "ingredients": ["a", {"text": "b", "usdaName": "c"}', case when conv_id % 4 = 0 then ', {"text": "d"}' else ', {"text": "e", "usdaName": "f"}' end, '], "steps": ["s"]}\n```') else '\n```json\n{"title": "no"}\n```' end)"""))
    found = P.chat_recipes(said, "said")
    names = F.array_join(F.transform(F.map_entries("names"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return found.select("conv_id", "turn", "title", F.array_join("ingredients", "|").alias("ingredients"), names.alias("names"))


def x21_caption_text(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    xml = turns.withColumn("said", F.expr("replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")).withColumn("xml", F.expr("""case when turn % 2 = 0 then concat("<t><text start='0'>", said, "</text><text> a &amp; b</text></t>") else concat("<body><p t='0'><s>", said, "</s><s> a</s></p><p>&amp; b</p><text>no</text></body>") end"""))
    return xml.select("conv_id", "turn", P.caption_track_text(F.col("xml")).alias("caption"))


QUERIES |= {f.__name__: f for f in (x1_jsonld_blocks, x2_jsonld_recipes, x3_microdata, x4_headings, x5_best_layer, x6_recipes, a12_extraction_quality, x14_decode_entities, x9_steps, s8_share_round_trip, s15_fit_share_link, s14_import_inbox, x22_chat_recipes, x21_caption_text)}
_TITLE = "'Recipe ' || page_id || ' & more' as title"
#: The parts that each page's recipe was built of, put together again without any parser.
_BUILT = f"""with given as (select page_id, {PART} as kind, regexp_extract_all(html, '[A-Za-z]{{4,}}')[1:page_id % 4 + 1] as w from pages),
parts as (select *, {_TITLE}, case when kind = 4 then [] else list_transform(w, lambda x: '2 cups ' || x) end as items,
list_transform(w, lambda x: 'Mix the ' || x || case when kind = 4 then '.' else '' end) as mixed from given),
told as (select *, case kind when 2 then list_prepend('Dough: ' || mixed[1], mixed[2:]) || ['End: Tip: chill'] when 4 then mixed || ['Serve immediately.'] when 5 then list_prepend('[Dough]', mixed) else mixed || ['Tip: chill'] end as steps from parts)"""
_NAMES = ", ".join("('{}', '{}')".format(name, plain.replace("'", "''")) for name, plain in html5.items())
_LISTS = "array_to_string(items, '|') as ingredients, array_to_string(steps, '|') as steps"
_FULL = "kind in (0, 1, 3)"
ORACLE_SQL |= {
    "x1_jsonld_blocks": f"select page_id, 0::bigint as block from pages where {PART} in (0, 4, 5)",
    "x2_jsonld_recipes": f"select page_id, 'Recipe ' || page_id || ' &amp; more' as title from pages where {PART} in (0, 4, 5) union all select page_id, 'Empty' from pages where {PART} = 4",
    "x3_microdata": f"{_BUILT} select page_id, 0::bigint as item, title, w[1] as author, 3.0::double as fat_g, {_LISTS} from told where kind in (1, 3)",
    "x4_headings": f"{_BUILT} select page_id, title, 'https://i/' || page_id || '.png' as image, {_LISTS} from told where kind = 2",
    "x5_best_layer": f"{_BUILT} select page_id, {LAYER} as layer, title, {_LISTS} from told",
    "x6_recipes": f"""{_BUILT} select page_id, title, case when {_FULL} or kind = 4 then w[1] end as author, 'https://i/' || page_id || '.png' as image, case when {_FULL} then (page_id % 9 + 1) || ' servings' end as servings_text,
case when {_FULL} then (page_id % 9 + 1)::bigint end as servings, case when {_FULL} then nullif(page_id % 50, 0)::bigint end as prep_minutes, case when {_FULL} then (60 + page_id % 7)::bigint end as cook_minutes, null::bigint as total_minutes,
case when {_FULL} then (page_id % 700 + 0.5)::double end as calories, case when {_FULL} then 3.0::double end as fat_g, null::double as sugar_g, case when kind = 0 then array_to_string(w, '|') else '' end as keywords, case when kind = 0 then 'Dinner' else '' end as categories,
tags, len(items)::bigint as n_ingredients from (select *, {T.auto_tags(DUCK, "case when kind = 0 then 'Dinner|' || array_to_string(w, '|') else '' end", "title")} as tags from told) t""",
    "a12_extraction_quality": f"""{_BUILT} select {T.source_domain(DUCK, 'url')} as domain, {LAYER.replace('page_id', 't.page_id')} as layer, count(*) as n_recipes, round(avg(case when {_FULL} then 1.0 else 0.0 end), 4) as share_timed, sum(len(items))::bigint as n_lines,
case when sum(len(items)) > 0 then 1.0::double end as share_measured from told t join (select page_id as id, url from pages) p on t.page_id = p.id group by all""",
    "x14_decode_entities": f"""with names(name, plain) as (values {_NAMES}), cut as (select page_id, regexp_extract_all({REFERENCES}, '&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&') as parts from pages),
rows as (select page_id, unnest(parts) as part, generate_subscripts(parts, 1) as k from cut), named as (select distinct part from rows where part[1] = '&' and part[2] ~ '[A-Za-z]'),
best as (select part, max_by(plain || substr(part, length(name) + 2), length(name)) as told from named join names on starts_with(substr(part, 2), name) group by part)
select page_id, string_agg(case when starts_with(lower(part), '&#x') then chr(('0x' || regexp_extract(part[4:], '[0-9a-fA-F]+'))::integer) when starts_with(part, '&#') then chr(regexp_extract(part, '[0-9]+')::integer) else coalesce(told, part) end, '' order by k) as plain
from rows left join best using (part) group by page_id""",
    "x9_steps": f"{_BUILT} select page_id, generate_subscripts(steps, 1)::bigint as ord, unnest(steps) as text from told",
    "s8_share_round_trip": rf"""select doc_id, k as piece, 'Recipe ' || doc_id as title, array_to_string(w[k * {PIECE} + 1:(k + 1) * {PIECE}], ' ') as ingredients
from (select doc_id, w, unnest(range((len(w) + {PIECE} - 1) // {PIECE})) as k from (select doc_id, regexp_split_to_array(text, '\s+') as w from documents) s) p""",
    "s14_import_inbox": "select doc_id, case when doc_id % 5 <> 0 and doc_id % 3 <> 0 then source end as title, doc_id % 5 <> 0 and doc_id % 3 <> 0 as accepted from documents",
    "x22_chat_recipes": "select conv_id, turn, 'T' || conv_id as title, case when conv_id % 4 = 0 then 'a|b|d' else 'a|b|e' end as ingredients, case when conv_id % 4 = 0 then 'b=c' else 'b=c|e=f' end as names from conversations where role = 'assistant' and conv_id % 2 = 0",
    "x21_caption_text": r"select conv_id, turn, trim(regexp_replace(text || '  a & b', '[ \t\n\r\f]+', ' ', 'g')) as caption from conversations",
}
