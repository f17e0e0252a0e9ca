"""Grocery lists of all plans at once: selections join recipes and lines, sums go by list, name and unit system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import quantities as Q

#: Order of the shelves; unknown ones come last.
SHELVES = ["produce", "meat", "seafood", "dairy", "pantry", "spices", "frozen", "beverages"]
ORDER = ["line_no", "part_no", "supp_no"]


def selections(meals: DataFrame) -> DataFrame:
    """Each planned meal is a selection of its list (user and week); nothing is folded."""
    return meals.select("user_id", "week_start", "recipe_id", "serving_override", "day_no", "slot")


def chosen_lines(chosen: DataFrame, recipes: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of the chosen recipes, scaled to the wanted servings (Q1); unknown recipes are left out.

    A recipe in very many lists makes one side of the join hot; AQE splits it.
    """
    known = chosen.join(recipes.select("recipe_id", "title", "servings"), "recipe_id")
    wanted = F.coalesce("serving_override", F.coalesce("servings", F.lit(1)))
    scaled = known.withColumn("_to", wanted).withColumn("_from", F.coalesce("servings", F.lit(1))).join(lines, "recipe_id")
    return scaled.withColumn("qty", Q.column(Q.scale("qty_max", "_from", "_to"))).drop("_to", "_from")


def grocery_list(scaled: DataFrame, place: str | None = None) -> DataFrame:
    """A1, A2: one row per list, name and unit system.

    Quantities add up in base units, in the order of the lines: where two units suit a total equally
    well, its last bit decides, so that a sum in the order of arrival would give now one and now the other.
    place: a column of the lines by which they add up instead; names and notes keep the order of the lines.
    One missing quantity leaves the item without one. The displayed name is the first in order, notes are
    joined in order without repeats.
    """
    order = F.struct("recipe_id", *ORDER)
    keyed = scaled.withColumn("name_key", Q.column(Q.name_key("name"))).withColumn("system", Q.column(Q.system("unit"))).withColumn("base", Q.column(Q.to_base("qty", "unit")))
    base, note = F.col("base"), F.nullif("notes", F.lit("")).alias("note")
    rows = {"_rows": [order.alias("at"), base, note]} if place is None else {"_rows": [place, base], "_noted": [order.alias("at"), note]}
    sums = keyed.groupBy("user_id", "week_start", "name_key", "system").agg(
        *[F.sort_array(F.collect_list(F.struct(*columns))).alias(name) for name, columns in rows.items()],
        F.bool_or(F.col("qty").isNull()).alias("unknown"),
        F.bool_and("optional").alias("optional"),
        F.min_by("name", order).alias("display_name"),
        F.count("*").alias("n_sources"),
    )
    added = sums.withColumn("total", F.aggregate("_rows", F.lit(0.0), lambda total, x: total + F.coalesce(x["base"], F.lit(0.0))))
    total = F.when(~F.col("unknown") & (F.col("total") > 0), F.col("total"))
    shown = added.withColumn("total", total).withColumn("unit", F.when(F.col("total").isNotNull(), Q.column(Q.base_unit("total", "system"))))
    qty = F.when(F.col("system").isin("volume", "weight"), F.col("total") / Q.column(Q.factor("unit"))).otherwise(F.col("total"))
    notes = F.array_join(F.array_distinct(F.filter(F.transform("_rows" if place is None else "_noted", lambda x: x["note"]), lambda n: n.isNotNull())), "; ")
    return shown.select("user_id", "week_start", "name_key", "system", "display_name", qty.alias("qty"), "unit", F.when(notes != "", notes).alias("notes"), "optional", "n_sources")


def line_items(items: DataFrame) -> DataFrame:
    """Q11: a measured line item where the quantity is positive, else one each."""
    measured = F.col("qty") > 0
    return items.select(
        "*",
        F.when(measured, F.col("qty")).otherwise(F.lit(1.0)).alias("item_qty"),
        F.when(measured, Q.column(Q.shopping_unit("unit"))).otherwise("each").alias("item_unit"),
    )


def shopping_requests(items: DataFrame) -> DataFrame:
    """One request per list as JSON, items in name order; lists without items make none."""
    item = F.struct(F.col("name_key").alias("name"), F.col("display_name").alias("display_text"), F.col("item_qty").alias("quantity"), F.col("item_unit").alias("unit"))
    rows = line_items(items).groupBy("user_id", "week_start").agg(F.array_sort(F.collect_list(item)).alias("line_items"))
    return rows.select("user_id", "week_start", F.size("line_items").alias("n_items"), F.to_json(F.struct(F.lit("Shopping List").alias("title"), "line_items")).alias("request"))


#: Heads of the categories; that of custom items.
HEADS = {"produce": "Produce", "meat": "Meat & Poultry", "seafood": "Seafood", "dairy": "Dairy", "pantry": "Pantry", "spices": "Spices", "frozen": "Frozen", "beverages": "Beverages", "other": "Other"}
CUSTOM = "Custom Items"


def list_text(items: DataFrame, manual: DataFrame) -> DataFrame:
    """(user_id, week_start, text): lists by category, in the order in which categories come first, then custom items; [x] before checked ones.

    items has category (null: other) and checked besides a list's columns, and is taken in the order of names;
    manual (user_id, week_start, item, checked) comes last. A list's lines are put together by category first.
    """
    mark = F.when(F.col("checked"), F.lit("[x] ")).otherwise("[ ] ")
    own = items.select(
        "user_id", "week_start", F.lit(False).alias("custom"), F.coalesce("category", F.lit("other")).alias("category"),
        F.struct(F.col("display_name").alias("a"), F.coalesce("system", F.lit("")).alias("b")).alias("place"), F.concat(mark, Q.column(Q.format_item("qty", "unit", "display_name", "notes", "optional"))).alias("line"),
    )
    hand = manual.select("user_id", "week_start", F.lit(True).alias("custom"), F.lit(CUSTOM).alias("category"), F.struct(F.col("item").alias("a"), F.lit("").alias("b")).alias("place"), F.concat(mark, "item").alias("line"))
    groups = own.unionByName(hand).groupBy("user_id", "week_start", "custom", "category").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("rows"))
    head = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in HEADS.items() for x in kv]), F.col("category")), F.concat(F.upper(F.substring("category", 1, 1)), F.substring("category", 2, 1 << 20)))
    text = F.concat_ws("\n", F.when(F.col("custom"), F.lit(CUSTOM)).otherwise(head), F.lit("---"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    parts = groups.select("user_id", "week_start", F.struct("custom", F.get("rows", F.lit(0))["place"].alias("place"), text.alias("text")).alias("part"))
    return parts.groupBy("user_id", "week_start").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"]), "\n\n").alias("text"))
