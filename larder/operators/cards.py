"""Recipes written out: schema.org JSON, a description of bounded length, and Markdown.

Inputs are recipes with title, ingredients and steps (array<string>), and of author, image_url, servings, prep_minutes, cook_minutes,
total_minutes, keywords, cuisines, categories (array<string>), nutrition (struct of numbers) and source_url
those that there are. All of it is columns of one row: no shuffle and no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Lengths between which a description should be, and what fills up a short one, the longer first.
SHORTEST, LONGEST = 80, 125
PADS = (" Just the recipe: clean ingredients and steps, no ads and no life story.", " Just the recipe — no ads, no life story.")
#: Lengths of a name that is worth telling, and how many of them.
NAME_FROM, NAME_TO, NAMES = 2, 31, 3
#: The measures that may stand before a name.
MEASURES = ("oz", "ounce", "ounces", "lb", "lbs", "pound", "pounds", "g", "gram", "grams", "kg", "ml", "l", "cup", "cups", "tbsp", "tbsps", "tsp", "tsps", "tablespoon", "tablespoons", "teaspoon", "teaspoons", "clove", "cloves", "sprig", "sprigs", "can", "cans", "packet", "packets", "stick", "sticks", "slice", "slices", "pinch", "pinches")
#: Fields of the card's nutrition, their units and ours.
NUTRITION = (
    ("calories", "calories", "calories"), ("fatContent", "fat_g", "g"), ("saturatedFatContent", "saturated_fat_g", "g"), ("carbohydrateContent", "carbohydrate_g", "g"), ("fiberContent", "fiber_g", "g"),
    ("sugarContent", "sugar_g", "g"), ("proteinContent", "protein_g", "g"), ("cholesterolContent", "cholesterol_mg", "mg"), ("sodiumContent", "sodium_mg", "mg"),
)


def _has(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _list(df: DataFrame, name: str) -> Column:
    return F.coalesce(_has(df, name, "array<string>"), F.array().cast("array<string>"))


def _more_than_none(minutes: Column) -> Column:
    return F.when(minutes > 0, minutes)


def iso_duration(minutes: Column) -> Column:
    """PT1H5M; null without minutes."""
    m = _more_than_none(minutes)
    hours, rest = F.floor(m / 60), m % 60
    told = F.concat(F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when((rest > 0) | (hours == 0), F.concat(rest.cast("string"), F.lit("M"))).otherwise(""))
    return F.when(m.isNotNull(), told)


def spoken(minutes: Column, minute: str = "m") -> Column:
    """1h 5m, 2h, 40m; null without minutes. minute: what stands behind minutes below an hour."""
    m = _more_than_none(minutes)
    hours, rest = F.floor(m / 60).cast("string"), (m % 60).cast("string")
    return F.when(m < 60, F.concat(m.cast("string"), F.lit(minute))).when(m % 60 == 0, F.concat(hours, F.lit("h"))).otherwise(F.concat(hours, F.lit("h "), rest, F.lit("m")))


def safe_url(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?://[^/?#\\s]"), url)


def bare_name(raw: Column) -> Column:
    """A line's name without costs, amount, measure and what follows a comma."""
    x = F.regexp_replace(raw, r"\s*\(\$[0-9]+(?:[.][0-9]{1,2})?\)", "")
    for gone in (r"^[0-9\s./¼½¾⅓⅔⅛-]+", rf"(?i)^(?:{'|'.join(MEASURES)})\b\s*", r",.*$"):
        x = F.regexp_replace(F.trim(x), gone, "")
    return F.trim(x)


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))


def _count(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def described(df: DataFrame, name: str = "description") -> DataFrame:
    """Df with the first names and how many more; time, servings and steps; categories and cuisines; filled up or cut on a word.

    Each part is a projection of its own, so that it is made once.
    """
    kept = [F.col(c) for c in df.columns if c != name]
    x = df.select(*kept, F.filter(F.transform("ingredients", bare_name), lambda n: F.length(n).between(NAME_FROM, NAME_TO)).alias("_names"))
    lead = F.concat_ws("", F.nullif(F.array_join(F.slice("_names", 1, NAMES), ", "), F.lit("")), F.when(F.size("_names") > NAMES, F.concat(F.lit(", and "), (F.size("_names") - NAMES).cast("string"), F.lit(" more"))))
    total, cook, servings = (_more_than_none(_has(df, c, "bigint")) for c in ("total_minutes", "cook_minutes", "servings"))
    ready = F.coalesce(F.concat(F.lit("ready in "), spoken(total)), F.concat(spoken(cook), F.lit(" cook time")))
    facts = F.concat_ws(", ", ready, F.concat(F.lit("serves "), servings.cast("string")), F.when(F.size("steps") > 0, _count(F.size("steps"), "step")))
    x = x.withColumn("_parts", F.filter(F.array(lead, facts, *[F.lower(F.array_join(_list(df, c), ", ")) for c in ("categories", "cuisines")]), lambda p: p != ""))
    some = F.array_join(F.transform("_parts", _capital), ". ")
    x = x.withColumn("_text", F.concat(F.when(some != "", some).otherwise(F.concat(F.lit("A recipe with "), _count(F.size("ingredients"), "ingredient"))), F.lit(".")))
    size = F.length("_text")
    pad = F.when(size >= SHORTEST, "")
    for p in PADS:
        pad = F.when(pad.isNotNull(), pad).when(size + len(p) <= LONGEST, p)
    x = x.withColumn("_text", F.concat("_text", F.coalesce(pad, F.lit(""))))
    cut = F.concat(F.regexp_replace(F.substring("_text", 1, LONGEST - 1), r"\s+\S*$", ""), F.lit("…"))
    return x.select(*kept, F.when(F.length("_text") > LONGEST, cut).otherwise(F.col("_text")).alias(name))


def schema_org(df: DataFrame, no_image: str) -> Column:
    """The JSON of df, which is described(), without empty fields; steps are counted, not told. no_image: the picture of recipes without a safe one."""
    some = lambda c: F.when(F.size(c) > 0, c)
    number = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    own = {f.name for f in df.schema["nutrition"].dataType.fields} if "nutrition" in df.columns else set()
    told = [F.concat(number(F.col(f"nutrition.{ours}")), F.lit(f" {unit}")).alias(name) for name, ours, unit in NUTRITION if ours in own]
    nutrition = F.when(F.col("nutrition").isNotNull(), F.struct(F.lit("NutritionInformation").alias("@type"), *told)) if told else F.lit(None).cast("string")
    author = _has(df, "author")
    fields = {
        "@context": F.lit("https://schema.org"),
        "@type": F.lit("Recipe"),
        "name": F.col("title"),
        "description": F.col("description"),
        "image": F.coalesce(safe_url(_has(df, "image_url")), F.lit(no_image)),
        "author": F.when(author != "", F.struct(F.lit("Person").alias("@type"), author.alias("name"))),
        "recipeYield": _more_than_none(_has(df, "servings", "bigint")).cast("string"),
        **{name: iso_duration(_has(df, c, "bigint")) for name, c in (("prepTime", "prep_minutes"), ("cookTime", "cook_minutes"), ("totalTime", "total_minutes"))},
        "keywords": F.nullif(F.array_join(_list(df, "keywords"), ", "), F.lit("")),
        "recipeCuisine": some(_list(df, "cuisines")),
        "recipeCategory": some(_list(df, "categories")),
        "recipeIngredient": F.transform("ingredients", lambda i: F.trim(F.regexp_replace(i, r"\s*\(\$[0-9]+(?:[.][0-9]{1,2})?\)", ""))),
        "recipeInstructions": F.when(F.size("steps") > 0, F.array(F.struct(F.lit("HowToSection").alias("@type"), F.lit("Instructions").alias("name"), F.size("steps").alias("numberOfItems")))),
        "nutrition": nutrition,
        "url": safe_url(_has(df, "source_url")),
    }
    # a closing tag inside would end the script that holds the card
    return F.replace(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])), F.lit("</"), F.lit("<\\/"))


def markdown(df: DataFrame, link: Column, label: str) -> Column:
    """Title, servings and times, ingredients, numbered steps, and a link with its label."""
    prep, cook, total = (_more_than_none(_has(df, f"{c}_minutes", "bigint")) for c in ("prep", "cook", "total"))
    named = lambda word, minutes: F.concat(F.lit(word), spoken(minutes, " min"))
    meta = F.concat_ws(" | ", F.concat(F.lit("Serves "), _more_than_none(_has(df, "servings", "bigint")).cast("string")), named("Prep: ", prep), named("Cook: ", cook), F.when(prep.isNull() & cook.isNull(), named("Total: ", total)))
    section = lambda head, column, line: F.when(F.size(column) > 0, F.concat(F.lit(f"**{head}**\n\n"), F.array_join(F.transform(column, line), "\n"), F.lit("\n")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("**"), F.col("title"), F.lit("**\n")),
        F.when(meta != "", F.concat(meta, F.lit("\n"))),
        section("Ingredients", "ingredients", lambda x: F.concat(F.lit("* "), x)),
        section("Instructions", "steps", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)),
        F.concat(F.lit(f"---\n\n[{label}]("), link, F.lit(")")),
    )
