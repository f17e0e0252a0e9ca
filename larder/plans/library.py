"""Recipe libraries of all users: upserts, latest-wins merges, patches, search, tags and changes."""

from __future__ import annotations

from larder.functions import text as T
from larder.functions.dialect import DUCK, SPARK

from .bindings import TABLES, bound, with_tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str, *tables: str, spark_sql: str | None = None) -> None:
    """A query over the bound tables; spark_sql where Spark has a better form than the SQL."""

    def query(spark, sf_dir):
        text = spark_sql or sql
        for t in tables:
            text = text.replace(f"from {t}", "from {" + t + "}").replace(f"join {t}", "join {" + t + "}")
        return spark.sql(text, **{t: bound(spark, sf_dir, t) for t in tables})

    QUERIES[name], ORACLE_SQL[name] = query, with_tables(("--and " + sql[5:]) if sql.startswith("with ") else sql, *tables)


assert set(TABLES) >= {"recipes", "meals", "lines"}
#: One row per key, the latest by (time, id): an aggregation of a struct, not a sort.
register(
    "w2_latest_per_slot",
    "select user_id, week_start, day_no, slot, recipe_id, serving_override from (select *, row_number() over (partition by user_id, week_start, day_no, slot order by updated_at desc, recipe_id desc) as rn from meals) q where rn = 1",
    "meals",
    spark_sql="select user_id, week_start, day_no, slot, m.recipe_id, m.serving_override from (select user_id, week_start, day_no, slot, max_by(struct(recipe_id, serving_override), struct(updated_at, recipe_id)) as m from meals group by user_id, week_start, day_no, slot) q",
)
register(
    "w3_latest_by_key",
    "select source_url, recipe_id, title from (select *, row_number() over (partition by source_url order by saved_at desc, recipe_id desc) as rn from recipes) q where rn = 1",
    "recipes",
    spark_sql="select source_url, m.recipe_id, m.title from (select source_url, max_by(struct(recipe_id, title), struct(saved_at, recipe_id)) as m from recipes group by source_url) q",
)
register(
    "w4_sync_merge",
    """with devices as (select recipe_id % 500 as id, user_id % 7 as device, saved_at as updated_at, recipe_id, recipe_id % 11 = 0 as deleted from recipes)
select id, device, recipe_id from (select *, row_number() over (partition by id order by updated_at desc, device desc, recipe_id desc) as rn from devices) q where rn = 1 and not deleted""",
    "recipes",
)
register(
    "s6_upsert",
    """with target as (select recipe_id, title, saved_at, 0 as batch from recipes where recipe_id % 3 <> 0),
changes as (select recipe_id, concat(title, ' (new)') as title, saved_at, 1 as batch from recipes where recipe_id % 2 = 0)
select recipe_id, title from (select *, row_number() over (partition by recipe_id order by batch desc, saved_at desc) as rn from (select * from target union all select * from changes) u) q where rn = 1""",
    "recipes",
)
#: What a user has set on a recipe stays when it is saved again; recipes without an address are not matched.
register(
    "j8_carry_user_fields",
    """with firsts as (select user_id, source_url, min(recipe_id) as recipe_id from recipes where source_url <> '' group by user_id, source_url),
old as (select r.user_id, r.source_url, r.tag, r.saved_at from recipes r join firsts f on r.recipe_id = f.recipe_id)
select n.recipe_id, coalesce(o.tag, n.tag) as tag, coalesce(o.saved_at, n.saved_at) as saved_at from (select * from recipes where recipe_id % 4 = 0) n left join old o on n.user_id = o.user_id and n.source_url = o.source_url""",
    "recipes",
)
register("j9_is_saved", "select m.user_id, m.recipe_id, m.day_no from meals m where m.recipe_id in (select recipe_id from recipes where tag = '1-URGENT')", "meals", "recipes", spark_sql="select m.user_id, m.recipe_id, m.day_no from meals m left semi join recipes r on m.recipe_id = r.recipe_id and r.tag = '1-URGENT'")
register("j10_bulk_nutrition", "select recipe_id, declared_calories from recipes where recipe_id in (select recipe_id from meals where user_id = 3)", "recipes", "meals")
register("j16_apply_patches", "select r.recipe_id, case when p.has_title then p.title else r.title end as title, coalesce(p.servings, r.servings) as servings from recipes r left join (select recipe_id, recipe_id % 10 = 0 as has_title, case when recipe_id % 20 = 0 then null else concat(title, '!') end as title, case when recipe_id % 15 = 0 then 9 end as servings from recipes where recipe_id % 5 = 0) p on r.recipe_id = p.recipe_id", "recipes")


def _search(d) -> str:
    """Favourites (here every third recipe) of two tags, with words in the title, the domain, a tag, or the name of a line."""
    hit = " or ".join(f"contains(lower({where}), '{word}')" for where, word in (("r.title", "77"), (T.source_domain(d, "r.source_url"), "site7."), ("r.tag", "low"), ("r.category", "quick")))
    return f"select r.recipe_id, r.user_id from recipes r where r.recipe_id % 3 = 0 and r.tag in ('5-LOW', '2-HIGH') and ({hit} or exists (select 1 from lines l where l.recipe_id = r.recipe_id and contains(lower(l.name), 'basil')))"


register("p9_search_library", _search(DUCK), "recipes", "lines", spark_sql=_search(SPARK).replace("{", "{{").replace("}", "}}"))
register("a10_custom_tags", "select distinct user_id, tag from recipes where tag not in ('1-URGENT', '2-HIGH')", "recipes")
register("u3_tags_minus_presets", "select tag from recipes except select tag from recipes where tag in ('1-URGENT', '2-HIGH')", "recipes")
register("u2_distinct_notes", "select distinct recipe_id, notes from lines where notes is not null", "lines")
register("o1_library_order", "select user_id, recipe_id, row_number() over (partition by user_id order by saved_at desc, recipe_id) as place from recipes", "recipes")
register("o2_latest_list", "select user_id, week_start from (select user_id, week_start, row_number() over (partition by user_id order by max(updated_at) desc, week_start desc) as rn from meals group by user_id, week_start) q where rn = 1", "meals", spark_sql="select user_id, max_by(week_start, struct(latest, week_start)) as week_start from (select user_id, week_start, max(updated_at) as latest from meals group by user_id, week_start) q group by user_id")
register("w1_renumber_steps", "select recipe_id, part_no, supp_no, line_no, row_number() over (partition by recipe_id order by line_no, part_no, supp_no) as ord from lines where not optional", "lines")
register("j3_meals_to_selection", "select user_id, week_start, recipe_id, serving_override from meals", "meals")
register("j1_selection_join", "select m.user_id, m.week_start, r.title, l.name, l.part_no, l.supp_no, l.line_no from meals m join recipes r on m.recipe_id = r.recipe_id join lines l on l.recipe_id = r.recipe_id", "meals", "recipes", "lines")
#: Recomputed only where the fingerprint of a recipe's lines has changed, or nothing is kept.
_LINES = {"spark": "sha2(array_join(transform(array_sort(collect_list(struct(line_no, part_no, supp_no, name))), x -> x.name), '\\n'), 256)", "duck": "sha256(string_agg(name, chr(10) order by line_no, part_no, supp_no))"}
register(
    "j15_changed_recipes",
    f"with prints as (select recipe_id, {_LINES['duck']} as print from lines group by recipe_id), cache as (select recipe_id, case when recipe_id % 4 = 0 then 'old' else print end as print from prints where recipe_id % 3 <> 0) select p.recipe_id from prints p where not exists (select 1 from cache c where c.recipe_id = p.recipe_id and c.print = p.print)",
    "lines",
    spark_sql=f"with prints as (select recipe_id, {_LINES['spark']} as print from lines group by recipe_id), cache as (select recipe_id, case when recipe_id % 4 = 0 then 'old' else print end as print from prints where recipe_id % 3 <> 0) select p.recipe_id from prints p left anti join cache c on c.recipe_id = p.recipe_id and c.print = p.print",
)
