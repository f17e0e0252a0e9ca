"""Ingredient parsing, categories and nutrition: distinct names meet small dimensions, sums go by recipe and day."""

from __future__ import annotations

import uuid
from math import ceil

from larder.functions import lines as L
from larder.functions import quantities as Q
from larder.functions import text as T
from larder.functions.dialect import DUCK, SPARK
from larder.sources.folders import shared

from .bindings import TABLES, bound

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: Own shelf words by rank: the first that a name contains decides.
SHELF_WORDS = [("green bean", "produce"), ("tomato", "produce"), ("onion", "produce"), ("garlic", "produce"), ("basil", "produce"), ("potato", "produce"), ("asparagus", "produce"), ("cherr", "produce"), ("peach", "produce"), ("scallion", "produce"), ("chicken", "meat"), ("beef", "meat"), ("butter", "dairy"), ("milk", "dairy"), ("egg", "dairy"), ("oil", "pantry"), ("flour", "pantry"), ("sugar", "pantry"), ("rice", "pantry"), ("salt", "spices")]
#: Other names of a food, and words before or after a name that do not change it.
ALIASES = {"oil": "vegetable oil", "cooking oil": "vegetable oil", "neutral oil": "vegetable oil", "pepper": "black pepper", "onions": "onion", "tomatoes": "tomato", "potatoes": "potato", "spring onion": "green onion", "spring onions": "green onion", "scallion": "green onion", "scallions": "green onion"}
BEHIND = ("cloves", "clove", "stalks", "stalk", "leaves", "leaf", "pieces", "piece", "heads", "head", "sprigs", "sprig")
BEFORE = ("fresh", "dried", "frozen", "chopped", "minced", "diced", "sliced", "shredded", "grated", "ground", "raw", "cooked", "canned", "boneless skinless", "boneless", "skinless", "crushed")
#: Own density rows, grams of a teaspoon; and grams of a piece.
DENSITY = {"butter": 4.7, "milk": 5.1, "olive oil": 4.5, "all-purpose flour": 2.6, "sugar": 4.2, "rice": 3.9, "basil": 0.9}
PIECES = {"egg": 50, "onion": 150, "tomato": 123, "potato": 150, "chicken breast": 174, "garlic": 3, "green onion": 15}


def raw_lines(d) -> str:
    """Lines as text: quantity, unit, name, preparation, note."""
    qty = Q.format_quantity("qty_min") if d is SPARK else Q.duck(Q.format_quantity("qty_min"))
    return f"""select recipe_id, line_no, part_no, supp_no, concat_ws(' ', case when part_no % 19 = 0 then '1½' when qty_max > qty_min then concat(cast(cast(floor(qty_min) as bigint) as {d.text_type}), '-', cast(cast(floor(qty_max) as bigint) as {d.text_type})) else {qty} end,
  case unit when 'tablespoon' then 'Tbsp.' when 'cup' then 'cups' when 'pound' then 'lbs' else unit end, case when part_no % 7 = 0 then 'freshly grated' end, name, case when part_no % 5 = 0 then '(about 2 bags)' when part_no % 11 = 0 then '(optional)' end) || case part_no % 4 when 0 then ', finely chopped' when 1 then ' to taste' else '' end as raw from lines"""


#: The table of matched() that Spark writes first.
MATCHES = "matched_names"
#: Where the number of tasks stands to which lines are dealt, and the lines of a task: what it holds does not grow with the table.
TASKS, LINES_OF_A_TASK = "number_of_tasks", 500_000


def _engine_sql(build, tables: tuple[str, ...]):
    """The query and its SQL of build(d), over bound tables."""

    def over(spark, sf_dir, text, **given):
        text = text.replace("{", "{{").replace("}", "}}")
        given |= {t: bound(spark, sf_dir, t) for t in tables}
        for t in given:
            text = text.replace(f"from {t}", "from {" + t + "}").replace(f"join {t}", "join {" + t + "}")
        return spark.sql(text, **given)

    def query(spark, sf_dir):
        text, given = build(SPARK), {}
        if MATCHES in text:
            # written, so that its size is known before lines are joined with it: a small table needs no shuffle of them
            path = f"{shared(spark)}/{MATCHES}-{uuid.uuid4().hex}"
            over(spark, sf_dir, matched(SPARK)).coalesce(1).write.parquet(path)
            given[MATCHES] = spark.read.schema("name string, food string").parquet(path)
        if TASKS in text:
            tasks = ceil(bound(spark, sf_dir, "lines").count() / LINES_OF_A_TASK)
            text = text.replace(TASKS, str(max(tasks, spark.sparkContext.defaultParallelism)))
        return over(spark, sf_dir, text, **given)

    duck = build(DUCK)
    with_ = ", ".join(f"{t} as ({TABLES[t]})" for t in tables)
    return query, f"with {with_} " + (", " + duck[5:] if duck.startswith("with ") else duck)


def register(name: str, build, *tables: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = _engine_sql(build, tables)


KEYS = "recipe_id, line_no, part_no, supp_no"


def _rounded(sql: str) -> str:
    return f"select {KEYS}, floor(qty_min * 1000 + 0.500001) / 1000 as qty_min, floor(qty_max * 1000 + 0.500001) / 1000 as qty_max, unit, name, prep, notes, optional from ({sql}) p"


def _parsed(d, lite: bool = False) -> str:
    """Parsed lines. People write the same lines again and again: Spark parses each text once and joins the lines with it."""
    if d is not SPARK:
        return L.parsed(d, raw_lines(d), KEYS, lite)
    texts = L.parsed(d, f"select distinct raw from ({raw_lines(d)}) t", "raw", lite)
    return f"select {KEYS}, qty_min, qty_max, unit, name, prep, notes, optional from ({raw_lines(d)}) l join ({texts}) p on l.raw <=> p.raw"


register("i1_parse_ingredients", lambda d: _rounded(_parsed(d)), "lines")
register("i9_parse_lite", lambda d: _rounded(_parsed(d, lite=True)), "lines")
_WORDS = "(values " + ", ".join(f"({k}, '{w}', '{c}')" for k, (w, c) in enumerate(SHELF_WORDS)) + ") as s(rank, word, shelf)"
#: I8: distinct names only meet the words; the winner is the word itself, else the lowest rank, and names are joined back.
_SHELF = f"select n.name, min_by(shelf, case when n.name = w.word then -1 else rank end) as shelf from (select distinct lower(name) as name from lines) n join (select * from {_WORDS}) w on contains(n.name, w.word) group by n.name"
register("i8_category", lambda d: f"select {KEYS}, s.shelf from lines l left join ({_SHELF}) s on lower(l.name) = s.name", "lines")


def candidates(d, names: str) -> str:
    """(name, keys) of (name) rows: keys under which a food may be known, best first; empty ones find nothing.

    Each step is a projection of its own, so that no pattern is matched twice.
    """
    ends = "endswith" if d is SPARK else "ends_with"
    less = lambda x: f"case when {ends}({x}, 's') then substring({x}, 1, length({x}) - 1) else '' end"
    alias = lambda x: f"case {x} " + " ".join(f"when '{a}' then '{b}'" for a, b in ALIASES.items()) + " else '' end"
    behind = rf"^(.*) (?:{'|'.join(BEHIND)})$"
    clean = f"select name, {T.clean_food_name(d, 'name')} as n from ({names}) given"
    parts = f"select name, n, {d.extract('n', behind)} as cut, {d.extract('n', rf'^(?:{chr(124).join(BEFORE)}) (.*)$')} as rest from ({clean}) c"
    keys = d.array("n", less("n"), f"case when {ends}(n, 's') then '' else concat(n, 's') end", alias("n"), "cut", less("cut"), "rest", less("rest"), alias("rest"), d.extract("rest", behind))
    return f"select name, {keys} as keys from ({parts}) p"


def matched(d) -> str:
    """(name, food): the first candidate key that the food table has, for distinct names."""
    keyed = candidates(d, "select distinct name from lines")
    if d is SPARK:
        each = f"select name, pos, key from ({keyed}) k lateral view outer posexplode(keys) e as pos, key"  # outer: else a filter on all keys goes down to every line
    else:
        each = f"select name, pos, keys[pos] as key from ({keyed}) k, unnest(range(1, len(keys) + 1)) u(pos)"
    return f"select name, min_by(food, pos) as food from ({each}) c join food f on c.key = f.food group by name"


def _matches(d) -> str:
    """matched(), in Spark as a written table."""
    return f"(select * from {MATCHES})" if d is SPARK else f"({matched(d)})"


def grams(qty: str, unit: str, food: str) -> str:
    """A3: grams of a quantity of a food, null if unknown."""
    volume = ", ".join(f"'{u}'" for u in Q.TEASPOONS)
    weight = ", ".join(f"'{u}'" for u in Q.GRAMS)
    density = f"case {food} " + " ".join(f"when '{k}' then {v}" for k, v in DENSITY.items()) + " else 4.0 end"
    piece = f"case {food} " + " ".join(f"when '{k}' then {v}" for k, v in PIECES.items()) + " end"
    return (
        f"case when {unit} in ({weight}) then {Q.to_base(qty, unit)} when {unit} in ({volume}) then {Q.to_base(qty, unit)} * ({density}) when {unit} = 'clove' then {qty} * 3"
        f" when {unit} = 'head' then {qty} * case when contains({food}, 'garlic') then 40 else 500 end when {unit} = 'stalk' then {qty} * 40 when {unit} = 'sprig' then {qty} * 2"
        f" when {unit} = 'stick' and contains({food}, 'butter') then {qty} * 113 when {unit} = 'bunch' then {qty} * case when {food} in ('basil', 'parsley') then 30 else 150 end"
        f" when {unit} is null or {unit} in ('piece', 'whole', 'large', 'medium', 'small') then {qty} * ({piece}) * case {unit} when 'large' then 1.25 when 'small' then 0.75 else 1.0 end end"
    )


def dealt(d, table: str) -> str:
    """The table's rows; Spark deals them by recipe, to as many tasks as the lines need."""
    return f"(select /*+ repartition({TASKS}, recipe_id) */ * from {table})" if d is SPARK else table


def weighed(d) -> str:
    """The lines with their food, action and grams (g), by the rules of A3 and default grams. They are dealt by recipe before, as sums of recipes need them."""
    known = f"select l.*, m.food, case when l.name = 'kosher salt' then 'SKIP' when l.name = 'rice' then 'ESTIMATE_QUANTITY' else 'MATCH' end as action, {grams('((qty_min + qty_max) / 2)', 'unit', 'm.food')} as g0 from {dealt(d, 'lines')} l left join {_matches(d)} m on l.name = m.name"
    return f"select *, case when coalesce(g0, 0) <= 0 and action = 'ESTIMATE_QUANTITY' and qty_min is null then 180.0 else g0 end as g from ({known}) k"


def per_line(d) -> str:
    """A4: what each line adds, rounded; salt is skipped and counts as matched, without any."""
    tenth = lambda c: f"floor(f.{c} * g / 100 * 10 + 0.500001) / 10"
    zero = lambda e: f"case when action = 'SKIP' then 0.0 when g > 0 then {e} end"
    macros = ", ".join(f"{zero(tenth(c))} as {c}" for c in ("protein", "fat", "carbs", "fiber"))
    return f"select recipe_id, line_no, part_no, supp_no, l.food, {zero('floor(f.kcal * g / 100 + 0.500001)')} as kcal, {macros} from ({weighed(d)}) l left join food f on l.food = f.food"


def lite(d) -> str:
    """Sums of what the lines add, rounded only at the end; servings of 1 at least; nothing matched is zero."""
    line = f"select l.recipe_id, case when action = 'SKIP' then 0.0 when g0 > 0 then f.kcal * g0 / 100 end as kcal from ({weighed(d)}) l left join food f on l.food = f.food"
    return f"select p.recipe_id, cast(floor(sum(coalesce(kcal, 0)) / greatest(coalesce(max(r.servings), 1), 1) + 0.500001) as bigint) as kcal, count(kcal) as n_matched, count(*) as n_lines from ({line}) p join recipes r on p.recipe_id = r.recipe_id group by p.recipe_id"


def per_recipe(d) -> str:
    """Sums of the matched lines for one serving, with confidence.

    Only matches with the food table are of high confidence in the rule, and there are no
    others here, so that its test of 0.7 on them is implied by the one of 0.8 on all.
    """
    macros = ("protein", "fat", "carbs", "fiber")
    totals = ", ".join(f"sum({c}) as {c}" for c in macros)
    served = ", ".join(f"floor({c} / coalesce(r.servings, 1) * 10 + 0.500001) / 10 as {c}" for c in macros)
    # calories of a line are whole: Spark adds them up as such, in less memory than decimals take
    kcal = "cast(sum(cast(kcal as bigint)) as decimal(31, 1))" if d is SPARK else "sum(kcal)"
    sums = f"select recipe_id, {kcal} as kcal, {totals}, count(kcal) as n_matched, count(*) as n_lines from ({per_line(d)}) p group by recipe_id"
    return f"select s.recipe_id, floor(kcal / coalesce(r.servings, 1) + 0.500001) as kcal, {served}, n_matched, n_lines, case when n_matched >= 0.8 * n_lines then 'high' when n_matched >= 0.5 * n_lines then 'medium' else 'low' end as confidence from ({sums}) s join recipes r on s.recipe_id = r.recipe_id where n_matched > 0"


def per_day(d) -> str:
    """Totals of each planned day, estimates first, declared values second."""
    meals = f"select m.user_id, m.week_start, m.day_no, coalesce(n.kcal, r.declared_calories) * coalesce(m.serving_override, 1) as kcal from {dealt(d, 'meals')} m join recipes r on m.recipe_id = r.recipe_id left join ({per_recipe(d)}) n on m.recipe_id = n.recipe_id"
    return f"select user_id, week_start, day_no, floor(sum(kcal) + 0.5) as kcal, count(*) as n_meals, count(kcal) as n_known from ({meals}) t group by user_id, week_start, day_no having count(kcal) > 0"


register("s5_food_dim", lambda d: "select food, kcal, protein, fat, carbs, fiber from food where food in (select distinct lower(name) from lines)", "food", "lines")
register("j4_match_food", matched, "lines", "food")
register("j14_unmatched_foods", lambda d: f"select distinct name from lines where name not in (select name from ({matched(d)}) m)", "lines", "food")
register("a3_grams", lambda d: f"select {KEYS}, floor(coalesce({grams('((qty_min + qty_max) / 2)', 'unit', 'm.food')}, -1) * 1000 + 0.500001) / 1000 as grams from lines l left join {_matches(d)} m on l.name = m.name", "lines", "food")
register("j5_density", lambda d: "select name, case lower(name) " + " ".join(f"when '{k}' then {v}" for k, v in DENSITY.items()) + " else 4.0 end as g_per_tsp from (select distinct name from lines) n", "lines")
register("j6_piece_weight", lambda d: f"select name, case {Q.name_key('name') if d is SPARK else Q.duck(Q.name_key('name'))} " + " ".join(f"when '{k}' then {v}" for k, v in PIECES.items()) + " end as g_per_piece from (select distinct name from lines) n", "lines")
register("j7_attach_normalized", lambda d: f"select {KEYS.replace('recipe_id', 'l.recipe_id').replace('line_no', 'l.line_no').replace('part_no', 'l.part_no').replace('supp_no', 'l.supp_no')}, coalesce(p.name, w.name, l.name) as name from lines l left join (select recipe_id, line_no, part_no, supp_no, 'by place' as name from lines where part_no % 3 = 0) p on l.recipe_id = p.recipe_id and l.line_no = p.line_no and l.part_no = p.part_no and l.supp_no = p.supp_no left join (select recipe_id, name as raw, 'by text' as name from lines where part_no % 5 = 0 group by recipe_id, name) w on l.recipe_id = w.recipe_id and l.name = w.raw", "lines")
register("a4_ingredient_nutrition", per_line, "lines", "food")
register("a5_recipe_nutrition", per_recipe, "lines", "food", "recipes")
register("a7_day_nutrition", per_day, "lines", "food", "recipes", "meals")
register("a8_day_source_first", lambda d: f"select m.user_id, m.week_start, m.day_no, floor(sum(coalesce(r.declared_calories, n.kcal)) + 0.5) as kcal from {dealt(d, 'meals')} m join recipes r on m.recipe_id = r.recipe_id left join ({per_recipe(d)}) n on m.recipe_id = n.recipe_id group by m.user_id, m.week_start, m.day_no", "lines", "food", "recipes", "meals")
register("a9_nutrition_lite", lite, "lines", "food", "recipes")
register("j2_meals_with_nutrition", lambda d: f"select m.user_id, m.week_start, m.recipe_id, coalesce(n.kcal, r.declared_calories) as kcal from {dealt(d, 'meals')} m join recipes r on m.recipe_id = r.recipe_id left join ({per_recipe(d)}) n on m.recipe_id = n.recipe_id", "lines", "food", "recipes", "meals")
register("o4_nutrition_sort", lambda d: f"select recipe_id, line_no, part_no, supp_no, row_number() over (partition by recipe_id order by coalesce(kcal, -1) desc, line_no, part_no, supp_no) as place from ({per_line(d)}) p", "lines", "food")
def nutrition_line(d) -> str:
    """A planned day in one line: calories, protein, fat and carbohydrate of its meals, and their number."""
    part = lambda c: f"coalesce(n.{c}, 0) * coalesce(m.serving_override, 1)"
    meals = f"select m.user_id, m.week_start, m.day_no, coalesce(n.kcal, r.declared_calories) * coalesce(m.serving_override, 1) as kcal, {', '.join(f'{part(c)} as {c}' for c in ('protein', 'fat', 'carbs'))} from {dealt(d, 'meals')} m join recipes r on m.recipe_id = r.recipe_id left join ({per_recipe(d)}) n on m.recipe_id = n.recipe_id"
    whole = lambda c: f"cast(cast(floor(sum({c}) + 0.500001) as bigint) as {d.text_type})"
    return f"select user_id, week_start, day_no, concat('day:', {whole('kcal')}, 'cal|', {whole('protein')}, 'p|', {whole('fat')}, 'f|', {whole('carbs')}, 'c|', cast(count(*) as {d.text_type}), 'meals') as line from ({meals}) t group by user_id, week_start, day_no having count(kcal) > 0"


def rescaled(d, original: int = 4, shown: int = 6) -> str:
    """Q12: a serving's values when its recipe is told for another number of servings, macros to a tenth; net carbohydrate is without fibre."""
    tenth = lambda x: f"floor(({x}) * 10 + 0.500001) / 10"
    adjusted = f"select recipe_id, floor(kcal * {original} / {shown}.0 + 0.500001) as kcal, {', '.join(f'{tenth(f'{c} * {original} / {shown}.0')} as {c}' for c in ('protein', 'fat', 'carbs', 'fiber'))} from ({per_recipe(d)}) t"
    return f"select *, {tenth('carbs - fiber')} as net_carbs from ({adjusted}) a"


register("d9_nutrition_line", nutrition_line, "lines", "food", "recipes", "meals")
register("q12_rescale", rescaled, "lines", "food", "recipes")
