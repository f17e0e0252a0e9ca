"""Queries over quantities and grocery lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import quantities as Q
from larder.operators import grocery as G

from .bindings import bound, with_tables
from .nutrition import SHELF_WORDS

#: The categories in the order of a list.
SHELVES = ("produce", "meat", "seafood", "dairy", "pantry", "spices", "frozen", "beverages")


def _r(x: str) -> str:
    return f"floor(({x}) * 1000 + 0.500001) / 1000"


def _lines(expressions: dict[str, str], keys="recipe_id, line_no, part_no, supp_no"):
    """A query and its SQL that project the same expressions from the lines."""

    def query(spark, sf_dir):
        return bound(spark, sf_dir, "lines").selectExpr(*keys.split(", "), *[f"{e} as {n}" for n, e in expressions.items()])

    sql = with_tables(f"select {keys}, " + ", ".join(f"{Q.duck(e)} as {n}" for n, e in expressions.items()) + " from lines", "lines")
    return query, sql


PROJECTIONS = {
    "q1_scale": {"qty_scaled": _r(Q.scale("qty_min", "4", "6")), "qty_top": _r(Q.scale("qty_max", "4", "6")), "qty_same": Q.scale("qty_min", "0", "6")},
    "q2_best_unit": {"unit_best": Q.best_unit("qty_min", "unit"), "qty_best": _r(Q.in_unit("qty_min", "unit", f"({Q.best_unit('qty_min', 'unit')})"))},
    "q3_to_base": {"base": _r(Q.to_base("qty_max", "unit")), "kind": Q.system("unit")},
    "q4_from_base": {"unit_shown": Q.base_unit("(qty_min * 37)", f"({Q.system('unit')})")},
    "q5_format_quantity": {"shown": Q.format_quantity("(qty_min / 3)")},
    "q6_format_item": {"shown": Q.format_item("qty_min", "unit", "name", "notes", "optional"), "span": f"case when qty_min is not null then concat({Q.format_quantity('qty_min')}, '–', {Q.format_quantity('qty_max')}) end"},
    "q9_minutes": {"plain": Q.minutes_text("(part_no % 200)"), "iso": Q.minutes_iso("(part_no % 200)")},
    "q10_shopping_unit": {"item_unit": Q.shopping_unit("unit")},
    "i7_name_key": {"name_key": Q.name_key("name")},
}


def _items(spark, sf_dir, placed=False):
    chosen = G.selections(bound(spark, sf_dir, "meals"))
    lines = G.chosen_lines(chosen, bound(spark, sf_dir, "recipes"), bound(spark, sf_dir, "lines", placed))
    return G.grocery_list(lines, "place" if placed else None)


def a1_grocery_list(spark, sf_dir):
    return _items(spark, sf_dir).withColumn("qty", F.expr(_r("qty")))


def q11_line_items(spark, sf_dir):
    """Line items whose lines add up as they lie in their table: the SQL's result has no column that hangs on the order of lines, so nothing puts them in it."""
    return G.line_items(_items(spark, sf_dir, placed=True)).select("user_id", "week_start", "name_key", "system", F.expr(_r("item_qty")).alias("item_qty"), "item_unit")


def s7_shopping_requests(spark, sf_dir):
    return G.shopping_requests(_items(spark, sf_dir))


def s13_grocery_text(spark, sf_dir):
    """Lists with categories by shelf word; every other source count is checked, and meals without a serving count are custom items."""
    items = _items(spark, sf_dir).withColumn("category", F.expr(shelf_name("display_name"))).withColumn("checked", F.col("n_sources") % 2 == 0)
    hand = bound(spark, sf_dir, "meals").where("serving_override is null").select("user_id", "week_start", F.concat(F.lit("Note "), F.col("recipe_id").cast("string")).alias("item"), (F.col("recipe_id") % 2 == 0).alias("checked"))
    return G.list_text(items, hand)


def shelf_name(name: str) -> str:
    """The category's name (I8), null without one; the same SQL in both engines."""
    return "case " + " ".join(f"when contains(lower({name}), '{w}') then '{shelf}'" for w, shelf in SHELF_WORDS) + " end"


def shelf_rank(name: str) -> str:
    """O3: the rank of a name's category (I8: the first shelf word that it holds), 99 without one; the same SQL in both engines."""
    return "case " + " ".join(f"when contains(lower({name}), '{w}') then {SHELVES.index(shelf)}" for w, shelf in SHELF_WORDS) + " else 99 end"


def o3_grocery_order(spark, sf_dir):
    ranked = _items(spark, sf_dir).withColumn("shelf", F.expr(shelf_rank("display_name")))
    rows = ranked.groupBy("user_id", "week_start").agg(F.array_sort(F.collect_list(F.struct("shelf", F.lower("display_name").alias("l"), "display_name"))).alias("rows"))
    return rows.select("user_id", "week_start", F.array_join(F.transform("rows", lambda r: r["display_name"]), "|").alias("names"))


def a17_line_item_counts(spark, sf_dir):
    chosen = G.selections(bound(spark, sf_dir, "meals")).groupBy("user_id", "week_start").agg(F.count("*").alias("n_recipes"))
    return _items(spark, sf_dir).groupBy("user_id", "week_start").agg(F.count("*").alias("n_items")).join(chosen, ["user_id", "week_start"])


def a11_list_progress(spark, sf_dir):
    done = F.col("qty").isNull() | F.col("optional")
    return _items(spark, sf_dir).groupBy("user_id", "week_start").agg(F.count_if(done).alias("n_checked"), F.count("*").alias("n_items"))


def p12_unchecked(spark, sf_dir):
    return _items(spark, sf_dir).where(~F.col("optional")).select("user_id", "week_start", "name_key", "system")


def u1_with_manual(spark, sf_dir):
    """Listed items, then the manual ones (here: one for each user's meal without a serving count)."""
    own = _items(spark, sf_dir).select("user_id", "week_start", F.col("display_name").alias("item"), F.lit(False).alias("manual"))
    hand = bound(spark, sf_dir, "meals").where("serving_override is null").select("user_id", "week_start", F.concat(F.lit("Note "), F.col("recipe_id").cast("string")).alias("item"), F.lit(True).alias("manual"))
    return own.unionByName(hand)


_KEYED = f"""--and scaled as (
  select m.user_id, m.week_start, l.*, {Q.scale('l.qty_max', 'coalesce(r.servings, 1)', 'coalesce(m.serving_override, r.servings, 1)')} as qty
  from meals m join recipes r on m.recipe_id = r.recipe_id join lines l on l.recipe_id = r.recipe_id),
keyed as (select *, {Q.duck(Q.name_key('name'))} as name_key, {Q.system('unit')} as system, {Q.to_base('qty', 'unit')} as base,
  row_number() over (order by recipe_id, line_no, part_no, supp_no) as rn from scaled),
notes as (select user_id, week_start, name_key, system, string_agg(notes, '; ' order by rn) as notes from (
  select user_id, week_start, name_key, system, notes, min(rn) as rn from keyed where notes <> '' group by all) group by all),
sums as (select user_id, week_start, name_key, system, sum(base) as total, bool_or(qty is null) as unknown, bool_and(optional) as optional,
  arg_min(name, rn) as display_name, count(*) as n_sources from keyed group by all),
shown as (select *, case when not unknown and total > 0 then total end as t from sums),
united as (select *, case when t is not null then {Q.duck(Q.base_unit('t', 'system'))} end as unit from shown),
items as (select u.user_id, u.week_start, u.name_key, u.system, display_name,
  case when u.system in ('volume', 'weight') then t / {Q.factor('unit')} else t end as qty, unit, n.notes, optional, n_sources
  from united u left join notes n on u.user_id = n.user_id and u.week_start = n.week_start and u.name_key = n.name_key and u.system is not distinct from n.system)
"""


def _sql(select: str) -> str:
    return with_tables(_KEYED + select, "lines", "recipes", "meals")


QUERIES = {
    "a1_grocery_list": a1_grocery_list,
    "q11_line_items": q11_line_items,
    "s7_shopping_requests": s7_shopping_requests,
    "s13_grocery_text": s13_grocery_text,
    "o3_grocery_order": o3_grocery_order,
    "a17_line_item_counts": a17_line_item_counts,
    "a11_list_progress": a11_list_progress,
    "p12_unchecked": p12_unchecked,
    "u1_with_manual": u1_with_manual,
}
ORACLE_SQL = {
    "a1_grocery_list": _sql(f"select user_id, week_start, name_key, system, display_name, {_r('qty')} as qty, unit, notes, optional, n_sources from items"),
    "q11_line_items": _sql(f"select user_id, week_start, name_key, system, case when qty > 0 then {_r('qty')} else 1 end as item_qty, case when qty > 0 then {Q.shopping_unit('unit')} else 'each' end as item_unit from items"),
    "s13_grocery_text": _sql(f"""select user_id, week_start, string_agg(head || chr(10) || '---' || chr(10) || body, chr(10) || chr(10) order by custom, first_name, first_system) as text from (
  select user_id, week_start, false as custom, case shelf {' '.join(f"when '{k}' then '{v}'" for k, v in G.HEADS.items())} end as head, arg_min(display_name, (display_name, sys)) as first_name, arg_min(sys, (display_name, sys)) as first_system,
    string_agg(case when n_sources % 2 = 0 then '[x] ' else '[ ] ' end || line, chr(10) order by display_name, sys, line) as body
  from (select *, coalesce({shelf_name('display_name')}, 'other') as shelf, coalesce(system, '') as sys, {Q.duck(Q.format_item('qty', 'unit', 'display_name', 'notes', 'optional'))} as line from items) i group by user_id, week_start, shelf
  union all select user_id, week_start, true, 'Custom Items', '', '', string_agg(case when recipe_id % 2 = 0 then '[x] ' else '[ ] ' end || 'Note ' || recipe_id, chr(10) order by 'Note ' || recipe_id, recipe_id % 2) from meals where serving_override is null group by user_id, week_start) g group by user_id, week_start"""),
    "o3_grocery_order": _sql("select user_id, week_start, string_agg(display_name, '|' order by " + shelf_rank("display_name") + ", lower(display_name), display_name) as names from items group by all"),
    "a17_line_item_counts": _sql("select i.user_id, i.week_start, count(*) as n_items, any_value(c.n) as n_recipes from items i join (select user_id, week_start, count(*) as n from meals group by all) c on i.user_id = c.user_id and i.week_start = c.week_start group by 1, 2"),
    "a11_list_progress": _sql("select user_id, week_start, count_if(qty is null or optional) as n_checked, count(*) as n_items from items group by all"),
    "p12_unchecked": _sql("select user_id, week_start, name_key, system from items where not optional"),
    "u1_with_manual": _sql("select user_id, week_start, display_name as item, false as manual from items union all select user_id, week_start, 'Note ' || cast(recipe_id as varchar), true from meals where serving_override is null"),
}
for _name, _expressions in PROJECTIONS.items():
    QUERIES[_name], ORACLE_SQL[_name] = _lines(_expressions)
