"""The given star schema bound to recipe tables, by projections that read the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Own words: twelve units (one missing) and names of ingredients.
UNITS = ["cup", "tablespoon", "teaspoon", "ounce", "pound", "gram", "kilogram", "milliliter", "clove", "can", None, "bunch"]
NAMES = ["Tomatoes", "yellow onions", "olive oil", "all-purpose flour", "butter", "garlic cloves", "fresh basil leaves", "granulated sugar", "eggs", "chicken breasts", "kosher salt", "milk", "green beans", "potatoes", "asparagus", "Cherries", "ground beef", "scallions", "Halves of peaches", "rice"]


def pick(values: list, index: str) -> str:
    """values[index] as a CASE."""
    rows = " ".join(f"when {k} then " + ("cast(null as varchar(50))" if v is None else "'" + v + "'") for k, v in enumerate(values))
    return f"case {index} {rows} end"


LINES = f"""
select l_orderkey as recipe_id, l_linenumber as line_no, l_partkey as part_no, l_suppkey as supp_no,
  {pick(UNITS, 'l_partkey % 12')} as unit, {pick(NAMES, f'l_partkey % {len(NAMES)}')} as name,
  case when l_partkey % 17 = 0 then null else l_quantity / 4 end as qty_min,
  case when l_partkey % 17 = 0 then null when l_suppkey % 10 = 0 then l_quantity / 4 + 1 else l_quantity / 4 end as qty_max,
  l_returnflag = 'R' as optional, case when l_linestatus = 'F' then l_returnflag end as notes
from lineitem"""
RECIPES = """
select o_orderkey as recipe_id, o_custkey as user_id, case when o_orderkey % 9 = 0 then null else o_orderkey % 6 + 1 end as servings,
  concat('Recipe ', cast(o_orderkey as varchar(20))) as title, o_orderdate as saved_at,
  case when o_orderkey % 13 = 0 then '' else concat('https://www.site', cast(o_custkey % 50 as varchar(20)), '.example.com/r/', cast(o_orderkey % 1000 as varchar(20))) end as source_url,
  o_orderpriority as tag, case o_orderstatus when 'F' then 'dinner' when 'O' then 'quick dessert' else 'Breakfast' end as category,
  case when o_orderkey % 7 = 0 then null else cast(floor(o_totalprice / 100) as bigint) end as declared_calories
from orders"""
MEALS = """
select o_custkey % 40 as user_id, cast(date_trunc('week', o_orderdate) as date) as week_start, o_orderkey % 7 as day_no, o_orderkey % 3 as slot,
  o_orderkey as recipe_id, case when o_orderkey % 5 = 0 then 2 * (o_orderkey % 4 + 1) end as serving_override, o_orderdate as updated_at
from orders"""
#: Own food rows (name, kilocalories, protein, fat, carbohydrate and fibre of 100 g), rounded from public composition tables.
FOODS = [
    ("tomato", 18, 0.9, 0.2, 3.9, 1.2), ("onion", 40, 1.1, 0.1, 9.3, 1.7), ("olive oil", 884, 0, 100, 0, 0), ("all-purpose flour", 364, 10.3, 1, 76.3, 2.7),
    ("butter", 717, 0.9, 81.1, 0.1, 0), ("garlic", 149, 6.4, 0.5, 33.1, 2.1), ("basil", 23, 3.2, 0.6, 2.7, 1.6), ("sugar", 387, 0, 0, 100, 0), ("egg", 143, 12.6, 9.5, 0.7, 0),
    ("chicken breast", 120, 22.5, 2.6, 0, 0), ("milk", 61, 3.2, 3.3, 4.8, 0), ("green beans", 31, 1.8, 0.2, 7, 2.7), ("potato", 77, 2, 0.1, 17.5, 2.1),
    ("beef", 254, 17.2, 20, 0, 0), ("green onion", 32, 1.8, 0.2, 7.3, 2.6), ("cherry", 63, 1.1, 0.2, 16, 2.1),
]
FOOD = "select * from (values " + ", ".join(f"('{n}', cast({a} as double), cast({b} as double), cast({c} as double), cast({d} as double), cast({e} as double))" for n, a, b, c, d, e in FOODS) + ") as t(food, kcal, protein, fat, carbs, fiber)"

TABLES = {"lines": LINES, "recipes": RECIPES, "meals": MEALS, "food": FOOD}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The place of a row in its table: files by name, rows as they are stored.
PLACE = "struct(_metadata.file_path as file, _metadata.row_index as row) as place"


def bound(spark: SparkSession, sf_dir: str, name: str, placed: bool = False) -> DataFrame:
    """One of TABLES over the given files; placed: with the place of each row in its table as a column."""
    given = {t: table(spark, sf_dir, t) for t in ("lineitem", "orders") if f"from {t}" in TABLES[name]}
    text = TABLES[name]
    for t in given:
        text = text.replace(f"\nfrom {t}", f"{', place' if placed else ''}\nfrom {{{t}}}")
    if placed:
        given = {t: df.selectExpr("*", PLACE) for t, df in given.items()}
    return spark.sql(text, **given)


def with_tables(sql: str, *names: str) -> str:
    """DuckDB SQL over the bound tables."""
    return "with " + ", ".join(f"{n} as ({TABLES[n]})" for n in names) + (", " if sql.lstrip().startswith("--and") else " ") + sql.replace("--and", "", 1)
