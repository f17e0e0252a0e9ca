"""Ingredient lines to quantity, unit, name, preparation and notes: regular expressions only, no shuffle."""

from __future__ import annotations

from .dialect import Dialect

#: Vulgar fractions.
FRACTIONS = {"¼": "1/4", "½": "1/2", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}
#: Units and their other spellings; the plain plural with s is understood.
UNITS = {
    "teaspoon": ("tsp", "tsps", "t"),
    "tablespoon": ("tbsp", "tbsps", "tbs", "tbl"),
    "cup": ("c",),
    "fluid ounce": ("fl oz", "floz"),
    "pint": ("pt",),
    "quart": ("qt", "qts"),
    "gallon": ("gal",),
    "milliliter": ("ml", "mls"),
    "liter": ("litre", "litres", "l"),
    "ounce": ("oz",),
    "pound": ("lb", "lbs"),
    "gram": ("g", "gm"),
    "kilogram": ("kg", "kgs"),
    "piece": ("pc", "pcs"),
    "pinch": ("pinches",),
    "dash": ("dashes",),
    "bunch": ("bunches",),
    "sprig": (),
    "clove": (),
    "slice": (),
    "head": (),
    "stalk": (),
    "stick": (),
    "can": (),
    "jar": (),
    "package": ("pkg",),
    "bag": (),
    "box": ("boxes",),
    "bottle": (),
    "handful": (),
    "drop": (),
}
SIZES = ("whole", "large", "medium", "small")
NO_PLURAL = ("pinch", "dash", "bunch", "box")
#: What is done to an ingredient, as phrases after its name.
PREPARED = (
    "chopped", "diced", "minced", "sliced", "crushed", "grated", "shredded", "julienned", "cubed", "halved", "quartered", "torn", "crumbled", "ground", "mashed",
    "peeled", "cored", "seeded", "deveined", "trimmed", "pitted", "zested", "sifted", "finely chopped", "finely diced", "finely minced", "finely sliced",
    "roughly chopped", "coarsely chopped", "thinly sliced", "freshly ground", "freshly grated", "freshly squeezed", "lightly packed", "firmly packed", "melted",
    "softened", "room temperature", "toasted", "roasted", "sauteed", "blanched", "drained", "rinsed", "drained and rinsed", "peeled and deveined", "beaten", "whisked",
    "lightly beaten", "well beaten", "cut into wedges", "cut into chunks", "cut into cubes", "at room temperature", "thawed", "frozen", "cooked", "uncooked", "raw",
    "divided", "plus more", "plus more for serving", "for garnish", "for serving", "to taste", "as needed", "warmed", "cooled", "chilled",
)
NUMBER = r"[0-9]+\s+[0-9]+/[0-9]+|[0-9]+/[0-9]+|[0-9]+[.][0-9]+|[0-9]+"
RANGE = rf"^({NUMBER})\s*(?:[-–—]|to)\s*({NUMBER})"


def spellings() -> dict[str, str]:
    """Every spelling and its unit, longest first."""
    out = {s: s for s in SIZES}
    for unit, others in UNITS.items():
        out |= {x: unit for x in (*others, unit)}
        if unit not in NO_PLURAL:
            out[unit + "s"] = unit
    return dict(sorted(out.items(), key=lambda x: (-len(x[0]), x[0])))


def normalize(d: Dialect, raw: str) -> str:
    """Trimmed, fractions in ASCII with a space after a digit, single spaces."""
    x = d.replace(raw, f"([0-9])([{''.join(FRACTIONS)}])", "$1 $2")
    for c, plain in FRACTIONS.items():
        x = f"replace({x}, '{c}', '{plain}')"
    return f"trim({d.replace(x, r'\s+', ' ')})"


def value(d: Dialect, n: str) -> str:
    """The number that a quantity's text means; null with a zero denominator."""
    whole = d.number(d.extract(n, r"^([0-9]+)\s"))
    top, under = d.number(d.extract(n, "([0-9]+)/")), d.number(d.extract(n, "/([0-9]+)"))
    return f"case when contains({n}, '/') then coalesce({whole}, 0) + {top} / nullif({under}, 0) else {d.number(f'nullif({n}, {chr(39) * 2})')} end"


def steps(d: Dialect, lite: bool = False) -> list[dict[str, str]]:
    """Projections one after the other, over a column raw; each may use the columns of those before."""
    alone = [s for s in spellings() if len(s) == 1]
    many = "|".join(s for s in spellings() if len(s) > 1)
    phrases = sorted(set(PREPARED), key=lambda p: (-len(p), p))
    after, before = "|".join(phrases), "|".join(p for p in phrases if " " in p and p.split()[0].endswith("ly"))
    notes = d.filter(d.map(d.all("line", r"\(([^)]+)\)"), "n", "trim(n)"), "n", "lower(n) <> 'optional'")
    cases = " ".join(f"when '{s}' then '{u}'" for s, u in spellings().items())
    # a map literal keeps Spark's generated code short
    unit = f"case spelt {cases} end" if d.name == "duck" else "try_element_at(map(" + ", ".join(f"'{s}', '{u}'" for s, u in spellings().items()) + "), spelt)"
    optional = r"(?i)\boptional\b"
    comma = "case when contains(substring(rest2, 2), ',') then trim(" + d.extract("rest2", "^([^,]+),") + ") end"
    behind = "trim(" + d.extract("rest2", "^[^,]+,(.*)$") + ")"
    is_prep = "head is not null" if lite else f"(head is not null and {d.like('lower(tail)', f'^({after})')})"
    low, high = f"({value(d, 'low')})", f"({value(d, 'high')})"
    mean = f"({low} + {high}) / 2"
    return [
        {"line": normalize(d, "raw")},
        {"notes": f"nullif({d.join(notes, '; ')}, '')", "paren_optional": d.like("line", r"(?i)\(\s*optional\s*\)"), "text": f"trim({d.replace(d.replace('line', r'\([^)]+\)', ' '), r'\s{2,}', ' ')})"},
        {"low": f"coalesce(nullif({d.extract('text', RANGE, 1)}, ''), {d.extract('text', f'^({NUMBER})', 1)})", "high": f"coalesce(nullif({d.extract('text', RANGE, 2)}, ''), {d.extract('text', f'^({NUMBER})', 1)})", "all_qty": f"coalesce(nullif({d.extract('text', RANGE, 0)}, ''), {d.extract('text', f'^({NUMBER})', 0)})"},
        {"qty_min": mean if lite else low, "qty_max": mean if lite else high, "rest": "trim(substring(text, length(all_qty) + 1))"},
        {"spelt": f"coalesce(nullif({d.extract('lower(rest)', f'^({many})(?:[^a-z]|$)')}, ''), {d.extract('lower(rest)', '^(' + '|'.join(alone) + ')(?:[ .]|$)')})"},
        {"unit": unit, "rest1": d.replace("substring(rest, length(spelt) + 1)", r"^[.]?\s*" + ("(?:of )?" if lite else ""))},
        {"optional": f"(paren_optional or {d.like('rest1', optional)})", "rest2": f"trim({d.replace('rest1', r'(?i),?\s*optional\b')})"},
        {"head": comma, "tail": behind},
        {"prep1": f"case when {is_prep} then tail end", "name1": f"case when {is_prep} then head else rest2 end"},
        {"prep2": "''" if lite else d.extract("lower(name1)", f" ({after})$"), "prep3": "''" if lite else d.extract("lower(name1)", f"^({before}) ")},
        {
            "name": "case when prep1 is not null then name1 when prep2 <> '' then trim(substring(name1, 1, length(name1) - length(prep2))) when prep3 <> '' then trim(substring(name1, length(prep3) + 1)) else name1 end",
            "prep": "case when prep1 is not null then prep1 when prep2 <> '' then substring(name1, length(name1) - length(prep2) + 1) when prep3 <> '' then substring(name1, 1, length(prep3)) end",
        },
    ]


def parsed(d: Dialect, source: str, keys: str, lite: bool = False) -> str:
    """SQL that parses the column raw of source (a select with keys and raw)."""
    out, columns = source, []
    for step in steps(d, lite):
        columns += list(step)
        out = f"select *, {', '.join(f'{e} as {n}' for n, e in step.items())} from ({out}) q{len(columns)}"
    return f"select {keys}, qty_min, qty_max, unit, name, prep, notes, optional from ({out}) q"
