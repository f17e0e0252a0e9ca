"""Recipes from crawled pages: JSON-LD by Spark's own functions, then microdata and headings by a small parser.

Each page is read once. Its JSON-LD is parsed inside its row, and html goes on to the parser
only where that gave no recipe with content.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from larder.functions import text as T
from larder.functions.dialect import SPARK
from larder.operators import trees
from larder.operators.entities import decoded
from larder.sources.batches import small_batches

SCRIPT = r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script>"
NONE = "cast(array() as array<variant>)"


def _items(v: str) -> str:
    """The objects of a parsed block: itself or its entries, and what their @graph lists."""
    tops = f"case when schema_of_variant({v}) like 'ARRAY%' then cast({v} as array<variant>) else array({v}) end"
    return f"flatten(transform({tops}, t -> concat(array(t), coalesce(try_variant_get(t, '$[\"@graph\"]', 'array<variant>'), {NONE}))))"


def _is_recipe(v: str) -> str:
    kind = f"lower(regexp_replace(to_json(try_variant_get({v}, '$[\"@type\"]', 'variant')), r'[\\[\\]\"]', ''))".replace("\\\\", "\\")
    return f"coalesce({kind} rlike '(^|,|/)recipe(,|$)', false)"


def jsonld_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block, json) of every valid JSON-LD script."""
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))).alias("block", "json"))
    return blocks.where(F.try_parse_json("json").isNotNull())


def jsonld_recipes(pages: DataFrame) -> DataFrame:
    """(page_id, block, item, json): recipes at the top, in a top array, or in @graph of either."""
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))).alias("block", "text"))
    parsed = blocks.withColumn("v", F.try_parse_json("text")).where("v is not null")
    items = parsed.select("page_id", "block", F.posexplode(F.expr(_items("v"))).alias("item", "r"))
    return items.where(_is_recipe("r")).select("page_id", "block", "item", F.to_json("r").alias("json"))


def _read(pages: DataFrame, read, columns: str) -> DataFrame:
    """A row for each tuple that read(html) gives."""
    small_batches(pages.sparkSession)
    schema = StructType([pages.schema["page_id"], *StructType.fromDDL(columns).fields])

    def run(frames):
        for frame in frames:
            rows = [(page_id, *told) for page_id, html in zip(frame["page_id"], frame["html"]) for told in read(trees.tree(html))]
            yield pd.DataFrame(rows, columns=schema.names)

    return pages.select("page_id", "html").mapInPandas(run, schema)


def microdata_recipes(pages: DataFrame) -> DataFrame:
    """(page_id, item, json) of all recipe scopes; nested scopes are objects in them."""
    return _read(pages, lambda page: [(i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(trees.microdata(page))], "item int, json string")


def heading_recipes(pages: DataFrame) -> DataFrame:
    """(page_id, json) of pages with an ingredients or an instructions heading that something follows."""
    return _read(pages, lambda page: [(json.dumps(x, ensure_ascii=False),) for x in [trees.headings(page)] if x], "json string")


def parsed(html: str) -> tuple[str, str] | None:
    """(layer, json) of a page without JSON-LD: its first microdata recipe with content, else what its headings give."""
    page = trees.tree(html)
    for item in trees.microdata(page):
        if item.get("recipeIngredient") or item.get("recipeInstructions"):
            return "microdata", json.dumps(item, ensure_ascii=False)
    found = trees.headings(page)
    return found and ("heuristic", json.dumps(found, ensure_ascii=False))


def best_layer(pages: DataFrame, *keep: str) -> DataFrame:
    """normalized() recipes of the first JSON-LD recipe with ingredients or steps, else of what the parser's layers find.

    Pages with JSON-LD that gives nothing (broken, no recipe, an empty one) go on to the other
    layers. Rows are independent: a page_id that stands twice gives a recipe for each row. Nothing is shuffled. keep: columns
    of pages that stay beside page_id.
    """
    small_batches(pages.sparkSession)
    blocks = F.expr(f"filter(transform(regexp_extract_all(html, r'{SCRIPT}', 1), b -> try_parse_json(b)), v -> v is not null)")
    marked = pages.select("page_id", *keep, "html", og_image(F.col("html")).alias("og"), blocks.alias("blocks"))
    full = f"{_is_recipe('r')} and (size({_ingredients('r')}) > 0 or size({_steps('r')}) > 0)"
    chosen = marked.select("page_id", *keep, "html", "og", F.expr(f"get(filter(flatten(transform(blocks, k -> {_items('k')})), r -> {full}), 0)").alias("r"))
    told = chosen.select("page_id", *keep, "og", F.to_json("r").alias("json"), F.when(F.col("r").isNull(), F.col("html")).alias("html"))
    schema = StructType([*[told.schema[c] for c in ("page_id", *keep)], *[StructField(c, StringType()) for c in ("og", "layer", "json")]])

    def run(frames):
        for frame in frames:
            rows = []
            for *own, og, told_json, html in frame.itertuples(index=False, name=None):
                found = ("jsonld", told_json) if told_json is not None else parsed(html) if html else None
                if found:
                    rows.append((*own, og, *found))
            yield pd.DataFrame(rows, columns=schema.names)

    return normalized(told.mapInPandas(run, schema)).where("size(ingredients) > 0 or size(steps) > 0")


def og_image(html: Column) -> Column:
    """The page's own picture, by either order of attributes."""
    name, told = r"""property\s*=\s*["']og:image["']""", r"""content\s*=\s*["']([^"']+)["']"""
    found = [F.nullif(F.regexp_extract(html, f"(?i)<meta[^>]*{a}[^>]*{b}[^>]*>", 1), F.lit("")) for a, b in ((name, told), (told, name))]
    return F.coalesce(*found)


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, r'(?U)^\s+|\s+$', '')"


def _string(v: str, path: str) -> str:
    return f"try_variant_get({v}, '$.{path}', 'string')"


def _first(v: str, field: str) -> str:
    """A field's text, or that of its first entry."""
    return f"coalesce({_string(v, field + '[0]')}, {_string(v, field)})"


def _list(v: str, field: str) -> str:
    return f"coalesce(try_variant_get({v}, '$.{field}', 'array<variant>'), {NONE})"


def _ingredients(v: str, field: str = "recipeIngredient") -> str:
    """Lines of a list, or a string alone; objects by their text or name; without empty ones."""
    line = "coalesce(try_variant_get(i, '$.text', 'string'), try_variant_get(i, '$.name', 'string'), try_variant_get(i, '$', 'string'), '')"
    alone = f"coalesce({_string(v, field)}, '')"
    kind = f"coalesce(schema_of_variant(try_variant_get({v}, '$.{field}', 'variant')), '')"
    lines = f"case when {kind} = 'STRING' then array({alone}) else transform({_list(v, field)}, i -> {line}) end"
    return f"filter(transform({lines}, l -> {_trim('l')}), l -> l <> '')"


def _sentences(one: str) -> str:
    """A text's lines, or if it is one line its sentences; numbers in front go."""
    bare = lambda x: rf"regexp_replace({_trim(x)}, r'^\d+\.\s*', '')"
    lines = rf"filter(split({one}, r'\n+'), y -> {_trim('y')} <> '')"
    return rf"case when size({lines}) > 1 then transform({lines}, y -> {bare('y')}) else transform(split({one}, r'(?<=[.!?])\s+(?=[A-Z])'), y -> {bare('y')}) end"


def _steps(v: str) -> str:
    """Instructions as lines: a string, or an array's only string, is cut; sections give [name] and their own steps; objects give their text. P10 decides what stays."""
    field = f"try_variant_get({v}, '$.recipeInstructions', 'variant')"
    kind = f"coalesce(schema_of_variant({field}), '')"
    every = _list(v, "recipeInstructions")
    is_text = lambda x: f"(schema_of_variant({x}) = 'STRING')"
    text = lambda x: f"try_variant_get({x}, '$', 'string')"
    said = lambda x: f"case when {is_text(x)} then {text(x)} else try_variant_get({x}, '$.text', 'string') end"
    name = "try_variant_get(s, '$.name', 'string')"
    inner = f"transform({_list('s', 'itemListElement')}, e -> {said('e')})"
    section = f"concat(case when coalesce({name}, '') <> '' then array(concat('[', {name}, ']')) else cast(array() as array<string>) end, {inner})"
    is_section = "coalesce(try_variant_get(s, '$[\"@type\"]', 'string') rlike '(^|/)HowToSection$', false)"
    alone = f"(size({every}) = 1 and {is_text(f'get({every}, 0)')})"
    many = f"flatten(transform({every}, s -> case when {is_section} then {section} else array({said('s')}) end))"
    lines = f"case when {kind} = 'STRING' then {_sentences(text(field))} when {alone} then {_sentences(text(f'get({every}, 0)'))} else {many} end"
    return f"filter(transform({lines}, z -> {_trim('z')}), z -> coalesce({T.is_instruction(SPARK, 'z')}, false))"


def _strings(v: str, field: str) -> str:
    """Parts of a comma list, trimmed, or the entries of an array; without empty ones."""
    kind = f"coalesce(schema_of_variant(try_variant_get({v}, '$.{field}', 'variant')), '')"
    parts = f"case when {kind} = 'STRING' then transform(split({_string(v, field)}, ','), p -> {_trim('p')}) else transform({_list(v, field)}, p -> try_variant_get(p, '$', 'string')) end"
    return f"filter({parts}, p -> coalesce(p, '') <> '')"


#: Fields of a source's nutrition, and ours.
NUTRITION = {"calories": "calories", "fatContent": "fat_g", "saturatedFatContent": "saturated_fat_g", "carbohydrateContent": "carbohydrate_g", "fiberContent": "fiber_g", "sugarContent": "sugar_g", "proteinContent": "protein_g", "cholesterolContent": "cholesterol_mg", "sodiumContent": "sodium_mg"}


def _image(v: str) -> str:
    """A string, the first of a list, or the url or contentUrl of an object."""
    paths = ("image[0].url", "image[0].contentUrl", "image.url", "image.contentUrl")
    plain = lambda path: f"case when schema_of_variant(try_variant_get({v}, '$.{path}', 'variant')) = 'STRING' then {_string(v, path)} end"
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in (plain("image"), plain("image[0]"), *(_string(v, p) for p in paths))) + ")"


def normalized(raw: DataFrame, lite: bool = False) -> DataFrame:
    """Recipes of raw ones in JSON, their other columns kept (og, if there, is the picture of last resort).

    title, author, description, image, servings_text, servings, prep_minutes, cook_minutes, total_minutes,
    ingredients, steps, nutrition (null where the source has none), keywords, cuisines, categories, tags.
    Names and lists may be strings, arrays or objects. The lite form also reads headline and ingredients.
    Character references are decoded in texts, not in addresses.
    """
    kept = [c for c in raw.columns if c not in ("json", "og")]
    v = raw.withColumn("v", F.try_parse_json("json"))
    duration = lambda field: F.expr(T.iso_minutes(SPARK, _string("v", field)))
    source = "try_variant_get(v, '$.nutrition', 'variant')"
    numbers = ", ".join(f"'{own}', {T.leading_number(SPARK, _string('v', f'nutrition.{name}'))}" for name, own in NUTRITION.items())
    title = f"coalesce(nullif({_first('v', 'name')}, ''), {_first('v', 'headline')}, 'Untitled Recipe')" if lite else f"coalesce(nullif({_first('v', 'name')}, ''), 'Untitled Recipe')"
    ingredients = _ingredients("v")
    if lite:
        ingredients = f"case when size({ingredients}) > 0 then {ingredients} else {_ingredients('v', 'ingredients')} end"
    named = "coalesce(try_variant_get(v, '$.author[0].name', 'string'), try_variant_get(v, '$.author.name', 'string'))"
    bare = "case when schema_of_variant(try_variant_get(v, '$.author[0]', 'variant')) = 'STRING' or schema_of_variant(try_variant_get(v, '$.author', 'variant')) = 'STRING' then " + _first("v", "author") + " end"
    read = v.select(
        *kept,
        F.expr(title).alias("title"),
        F.expr(f"nullif(coalesce({named}, {bare}), '')").alias("author"),
        F.expr(f"nullif({_first('v', 'description')}, '')").alias("description"),
        F.coalesce(F.expr(_image("v")), F.col("og") if "og" in raw.columns else F.lit(None)).alias("image"),
        F.expr(f"nullif({_first('v', 'recipeYield')}, '')").alias("servings_text"),
        duration("prepTime").alias("prep_minutes"),
        duration("cookTime").alias("cook_minutes"),
        duration("totalTime").alias("total_minutes"),
        F.expr(ingredients).alias("ingredients"),
        F.expr(_steps("v")).alias("steps"),
        F.expr(f"case when schema_of_variant({source}) like 'OBJECT%' then named_struct({numbers}) end").alias("nutrition"),
        *[F.expr(_strings("v", field)).alias(own) for field, own in (("keywords", "keywords"), ("recipeCuisine", "cuisines"), ("recipeCategory", "categories"))],
    )
    done = decoded(read, "title", "author", "description", "ingredients", "steps", "keywords", "cuisines", "categories")
    tags = T.auto_tags(SPARK, "array_join(categories, '|')", "array_join(keywords, '|')", "title")
    return done.withColumn("servings", F.expr(T.servings(SPARK, "servings_text"))).withColumn("tags", F.expr(tags))


def steps(recipes: DataFrame) -> DataFrame:
    """Step rows, numbered anew."""
    return recipes.select("page_id", F.posexplode("steps").alias("pos", "text")).select("page_id", (F.col("pos") + 1).alias("ord"), "text")


def chat_recipes(messages: DataFrame, text: str) -> DataFrame:
    """Messages with a fenced recipe that has a title, ingredients and steps: title, ingredients, steps, and names (text to food name, null without any)."""
    read = messages.withColumn("v", F.try_parse_json(F.regexp_extract(text, r"(?s)```(?:recipe-json|json)\s*(.*?)```", 1)))
    lists = {c: F.expr(f"try_variant_get(v, '$.{c}', 'array<variant>')") for c in ("ingredients", "steps")}
    read = read.withColumns({f"_{c}": e for c, e in lists.items()}).withColumn("title", F.expr(_string("v", "title"))).where("_ingredients is not null and _steps is not null and coalesce(title, '') <> ''")
    plain = lambda c: F.expr(f"transform(_{c}, x -> case when schema_of_variant(x) = 'STRING' then try_variant_get(x, '$', 'string') else try_variant_get(x, '$.text', 'string') end)")
    # a text that stands twice keeps its last name
    pairs = F.expr("filter(transform(_ingredients, x -> struct(try_variant_get(x, '$.text', 'string') as k, try_variant_get(x, '$.usdaName', 'string') as v)), p -> coalesce(p.k, '') <> '' and coalesce(p.v, '') <> '')")
    last = F.filter("_pairs", lambda p, i: ~F.exists(F.slice("_pairs", i + 2, F.size("_pairs")), lambda q: q["k"] == p["k"]))
    named = read.withColumn("_pairs", pairs).withColumn("names", F.when(F.size("_pairs") > 0, F.map_from_entries(last)))
    return named.withColumns({"ingredients": plain("ingredients"), "steps": plain("steps")}).drop("v", "_ingredients", "_steps", "_pairs")


def extraction_quality(recipes: DataFrame, *keys: str) -> DataFrame:
    """By keys and layer: recipes, their share with any time, their lines and the share of lines that begin with an amount."""
    amounts = F.size(F.filter("ingredients", lambda i: i.rlike(f"^{T.AMOUNT}")))
    timed = F.greatest("prep_minutes", "cook_minutes", "total_minutes").isNotNull()
    sums = recipes.groupBy(*keys, "layer").agg(F.count("*").alias("n_recipes"), F.count_if(timed).alias("timed"), F.sum(F.size("ingredients")).alias("n_lines"), F.sum(amounts).alias("measured"))
    return sums.select(*keys, "layer", "n_recipes", (F.col("timed") / F.col("n_recipes")).alias("share_timed"), "n_lines", F.when(F.col("n_lines") > 0, F.col("measured") / F.col("n_lines")).alias("share_measured"))


def ratings(pages: DataFrame, *keep: str) -> DataFrame:
    """(keep, image, rating, rating_count) of pages by their recipes' JSON-LD: the first picture, else the page's own, and the last rating."""
    recipes = f"filter(flatten(transform(filter(transform(regexp_extract_all(html, r'{SCRIPT}', 1), b -> try_parse_json(b)), v -> v is not null), k -> {_items('k')})), r -> {_is_recipe('r')})"
    rated = "try_element_at(filter(recipes, r -> try_variant_get(r, '$.aggregateRating', 'variant') is not null), -1)"
    found = pages.select(*keep, og_image(F.col("html")).alias("og"), F.expr(recipes).alias("recipes"))
    found = found.select(*keep, "og", F.expr(f"get(filter(transform(recipes, r -> {_image('r')}), i -> i is not null), 0)").alias("image"), F.expr(f"case when size(recipes) > 0 then try_variant_get({rated}, '$.aggregateRating', 'variant') end").alias("a"))
    number = lambda field: F.expr(T.leading_number(SPARK, f"try_variant_get(a, '$.{field}', 'string')"))
    some = lambda x: F.when(x != 0, x)
    count = F.coalesce(F.floor(number("ratingCount")), F.floor(number("reviewCount")))
    return found.select(*keep, F.coalesce("image", "og").alias("image"), some(number("ratingValue")).alias("rating"), some(count).alias("rating_count"))


def enriched(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Results with image, rating and rating_count of the page of their url, of several pages the one of the smallest page_id; results without a page stay."""
    facts = ratings(pages, "url", "page_id")
    one = facts.groupBy("url").agg(F.min_by(F.struct("image", "rating", "rating_count"), "page_id").alias("x")).select("url", "x.*")
    return results.join(one, "url", "left")


def caption_track_text(xml: Column) -> Column:
    """The text of the paragraphs of a caption track, without the tags inside; of one without paragraphs, that of its text nodes."""
    paragraphs = F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1)), lambda p: F.regexp_replace(p, r"<[^>]*>", ""))
    nodes = F.regexp_extract_all(xml, F.lit(r"(?s)<text(?:\s[^>]*)?>(.*?)</text>"), F.lit(1))
    joined = F.array_join(F.when(F.size(paragraphs) > 0, paragraphs).otherwise(nodes), " ")
    for name, plain in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        joined = F.replace(joined, F.lit(f"&{name};"), F.lit(plain))
    return F.trim(F.regexp_replace(joined, r"[ \t\n\r\f]+", " "))
