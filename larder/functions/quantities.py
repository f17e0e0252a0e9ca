"""Quantities and units: pure column expressions, no shuffle, no Python on the rows.

The expressions are SQL text over other expressions, so that they nest freely and stay
inside whole-stage code generation. Rounding is half up towards plus infinity.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Teaspoons of each volume unit and grams of each weight unit.
TEASPOONS = {"teaspoon": 1, "tablespoon": 3, "fluid ounce": 6, "cup": 48, "pint": 96, "quart": 192, "gallon": 768, "milliliter": 0.202884, "liter": 202.884}
GRAMS = {"gram": 1, "kilogram": 1000, "ounce": 28.3495, "pound": 453.592}
#: Fractions that are shown as such.
FRACTIONS = {"0.125": "1/8", "0.167": "1/6", "0.25": "1/4", "0.333": "1/3", "0.375": "3/8", "0.5": "1/2", "0.625": "5/8", "0.667": "2/3", "0.75": "3/4", "0.833": "5/6", "0.875": "7/8"}
NEAR = 0.02
QUOTED_GRAM, QUOTED_TEASPOON = "'gram'", "'teaspoon'"
#: The units that shopping requests know, and what other spellings become.
SHOPPING_UNITS = (
    "cup", "fluid_ounce", "gallon", "milliliter", "liter", "pint", "quart", "tablespoon", "teaspoon", "gram", "kilogram", "pound", "ounce", "each",
    "bunch", "can", "ear", "ears", "head", "heads", "large", "medium", "small", "package", "packet",
)
SHOPPING_NAMES = {
    "cup": ("cups", "c"),
    "fluid_ounce": ("fl oz", "fluid ounce", "fluid ounces"),
    "gallon": ("gal", "gallons"),
    "milliliter": ("ml", "milliliters"),
    "liter": ("l", "liters", "litres"),
    "pint": ("pints", "pt"),
    "quart": ("quarts", "qt"),
    "tablespoon": ("tbsp", "tablespoons", "tbs"),
    "teaspoon": ("tsp", "teaspoons"),
    "gram": ("g", "grams"),
    "kilogram": ("kg", "kilograms"),
    "pound": ("lb", "lbs", "pounds"),
    "ounce": ("oz", "ounces"),
    "bunch": ("bunches",),
    "can": ("cans",),
    "package": ("packages", "pkg"),
    "packet": ("packets", "pkt"),
}


def _double(x: float) -> str:
    return f"cast({x!r} as double)"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def rounded(x: str, places: int = 0) -> str:
    """Half-up rounding; a negative half goes up, too."""
    return f"floor({x} + 0.5)" if not places else f"(floor({x} * {10**places} + 0.5) / {10**places})"


def system(unit: str) -> str:
    """volume, weight, the counting unit itself, or null."""
    return f"case when {unit} in ({_quoted(TEASPOONS)}) then 'volume' when {unit} in ({_quoted(GRAMS)}) then 'weight' else nullif({unit}, '') end"


def factor(unit: str) -> str:
    """Base units (teaspoons or grams) of one unit; 1 for counting units and none."""
    cases = " ".join(f"when '{u}' then {_double(v)}" for u, v in {**TEASPOONS, **GRAMS}.items())
    return f"case {unit} {cases} else {_double(1)} end"


def to_base(qty: str, unit: str) -> str:
    return f"({qty} * {factor(unit)})"


def _clean(x: str) -> str:
    part = f"({x} - floor({x}))"
    close = " or ".join(f"abs({part} - {_double(float(f))}) < {_double(NEAR)}" for f in FRACTIONS)
    return f"({x} > 0 and ({part} < {_double(NEAR)} or 1 - {part} < {_double(NEAR)} or {close}))"


def awkwardness(x: str) -> str:
    """How ill a number suits a unit: lower is better."""
    return f"(case when {_clean(x)} then 0 else 10 end + case when {x} < 0.125 then 20 else 0 end + case when {x} > 16 then 15 else 0 end - case when {x} >= 0.25 and {x} <= 8 then 5 else 0 end)"


#: Shown units by system, larger ones first.
SHOWN = {"volume": ("cup", "tablespoon", "teaspoon"), "weight": ("pound", "ounce")}


def best_unit(qty: str, unit: str) -> str:
    """The unit of the same system that shows qty best; a change needs a strictly better score, larger units first."""

    def choice(kind: str) -> str:
        sizes = TEASPOONS | GRAMS
        own = f"struct(cast({qty} as double) as v, 0 as r, {unit} as u)"
        others = [f"struct({to_base(qty, unit)} / {_double(sizes[n])} as v, {k} as r, '{n}' as u)" for k, n in enumerate(SHOWN[kind], start=1)]
        return f"array_min(transform(array({', '.join([own, *others])}), c -> struct({awkwardness('c.v')} as s, c.r as r, c.u as u))).u"

    return f"case {system(unit)} when 'volume' then {choice('volume')} when 'weight' then {choice('weight')} else {unit} end"


def in_unit(qty: str, unit: str, target: str) -> str:
    return f"{to_base(qty, unit)} / {factor(target)}"


def base_unit(total: str, kind: str) -> str:
    """The unit in which a total of base units is shown; kind: what system() gives."""
    weight = f"nullif({best_unit(total, QUOTED_GRAM)}, 'gram')"
    return f"case {kind} when 'volume' then {best_unit(total, QUOTED_TEASPOON)} when 'weight' then coalesce({weight}, case when {total} >= 1000 then 'kilogram' when {total} >= 28 then 'ounce' else 'gram' end) else {kind} end"


def format_quantity(x: str) -> str:
    """x as people write it: 1 1/2, 2/3, 4, 1.7."""
    whole, part = f"floor({x})", f"({x} - floor({x}))"
    integer = f"cast(cast({whole} as bigint) as string)"
    cases = " ".join(f"when abs({part} - {_double(float(f))}) < {_double(NEAR)} then concat(case when {whole} > 0 then concat({integer}, ' ') else '' end, '{shown}')" for f, shown in FRACTIONS.items())
    tenth = f"cast(floor({x} * 10 + 0.5) as bigint)"
    decimal = f"concat(cast({tenth} div 10 as string), case when {tenth} % 10 = 0 then '' else concat('.', cast({tenth} % 10 as string)) end)"
    return f"case when {x} is null then null when {x} <= 0 then '0' when {part} < {_double(NEAR)} then {integer} {cases} when 1 - {part} < {_double(NEAR)} then cast(cast({whole} + 1 as bigint) as string) else {decimal} end"


def format_item(qty: str, unit: str, name: str, notes: str, optional: str) -> str:
    """2 cups flour (sifted) [optional]"""
    plural = f"case when {qty} > 1 and not endswith({unit}, 's') then concat({unit}, 's') else {unit} end"
    return f"concat_ws(' ', {format_quantity(qty)}, nullif({plural}, ''), {name}, case when {notes} <> '' then concat('(', {notes}, ')') end, case when {optional} then '[optional]' end)"


def scale(qty: str, servings: str, target: str) -> str:
    """qty for target servings; unchanged where either count is not positive."""
    return f"case when {servings} <= 0 or {target} <= 0 then {qty} else {qty} * ({target} / cast({servings} as double)) end"


def shopping_unit(unit: str) -> str:
    plain = f"lower(trim({unit}))"
    names = {n: k for k, v in SHOPPING_NAMES.items() for n in v}
    cases = " ".join(f"when {plain} = '{n}' then '{k}'" for n, k in names.items())
    return f"case when {unit} is null or {unit} = '' then 'each' when {plain} in ({_quoted(SHOPPING_UNITS)}) then {plain} {cases} else 'each' end"


def name_key(name: str) -> str:
    """An ingredient's name in lower case and the singular."""
    n = f"lower(trim({name}))"
    less = lambda k: f"substring({n}, 1, length({n}) - {k})"
    ends = lambda *s: "(" + " or ".join(f"endswith({n}, '{x}')" for x in s) + ")"
    return (
        f"case when length({n}) <= 3 or not endswith({n}, 's') or {ends('ss', 'us', 'is')} then {n}"
        f" when {ends('ies')} then concat({less(3)}, 'y') when {ends('ves')} then concat({less(3)}, 'f')"
        f" when {ends('oes', 'ches', 'shes', 'xes', 'zes')} then {less(2)} else {less(1)} end"
    )


def minutes_text(m: str) -> str:
    return f"case when {m} is null then null when {m} < 60 then concat(cast({m} as string), ' min') when {m} % 60 = 0 then concat(cast({m} div 60 as string), 'h') else concat(cast({m} div 60 as string), 'h ', cast({m} % 60 as string), 'm') end"


def minutes_iso(m: str) -> str:
    return f"case when coalesce({m}, 0) <= 0 then null else concat('PT', case when {m} >= 60 then concat(cast({m} div 60 as string), 'H') else '' end, case when {m} % 60 > 0 then concat(cast({m} % 60 as string), 'M') else '' end) end"


def column(expression: str) -> Column:
    return F.expr(expression)


def duck(expression: str) -> str:
    """The same text for DuckDB."""
    text = re.sub(r"array_min\(transform\(array\(", "list_sort(list_transform(list_value(", expression)
    text = re.sub(r"\), c -> struct\((.*?) as s, c\.r as r, c\.u as u\)\)\)\.u", r"), lambda c: struct_pack(s := \1, r := c.r, u := c.u)))[1].u", text)
    text = re.sub(r"struct\(([^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*) as v, (\d) as r, ('?[\w.]+'?) as u\)", r"struct_pack(v := \1, r := \2, u := \3)", text)
    return text.replace(" div ", " // ").replace(" as string)", " as varchar)").replace("endswith(", "ends_with(")
