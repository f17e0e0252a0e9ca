"""Times, lines of ingredients, sections of free text, captions and share links, against plain code by hand."""

import base64
import gzip
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.functions.dialect import SPARK
from larder.operators import texts
from larder.sources import payloads

UNITS = {"h": 3600, "m": 60, "s": 1}


def scanned(text):
    """Times by a scanner that tries every place, form after form."""
    unit = "(minutes?|mins?|hours?|hrs?|seconds?|secs?)"
    plain = re.sub(r"(?i)(?:about|approximately|around)\s+", lambda m: " " * len(m[0]), text)
    taken, out = set(), []
    for form in (rf"([0-9]+)\s+hours?\s+(?:and\s+)?([0-9]+)\s+{unit}", rf"([0-9]+)\s*(?:to|-)\s*([0-9]+)\s+{unit}", rf"([0-9]+)\s+{unit}"):
        at = 0
        while m := re.compile(form, re.I).search(plain, at):
            at = m.end()
            numbers = [int(g) for g in m.groups()[:-1]]
            if "hours" in form and "and" in form:
                seconds = numbers[0] * 3600 + numbers[1] * 60
            else:
                seconds = numbers[-1] * UNITS[m.groups()[-1][0].lower()]
            if seconds and not taken & set(range(m.start(), m.end())):
                taken |= set(range(m.start(), m.end()))
                out.append((seconds, text[m.start() : m.end()].strip(), m.start(), m.end()))
    return sorted(out, key=lambda x: x[2])


def test_times_equal_a_scanner(spark):
    rng = random.Random(2)
    words = ["5", "10", "0", "90", "-", "to", "and", "hour", "hours", "Minutes", "min", "secs", "about", "around", "bake", "😀", "1", "hr", ",", "\n"]
    rows = ["".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(25))) for _ in range(400)] + [None, "", "9" * 5000 + " minutes", "5 minutes " * 20_000]
    found = texts.timers(spark.createDataFrame(list(enumerate(rows)), "i long, t string"), "t").collect()
    for r in found:
        if rows[r.i] is None:
            assert r.timers is None
        elif len(rows[r.i]) < 1000:
            assert [tuple(t) for t in r.timers] == scanned(rows[r.i])
    assert [len(r.timers) for r in sorted(found, key=lambda r: r.i)[-2:]] == [1, 20_000]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Bake for 25 minutes", [(1500, "25 minutes")]),
        ("simmer about 10-15 min, then rest 1 hour and 30 minutes", [(900, "10-15 min"), (5400, "1 hour and 30 minutes")]),
        ("1 hour 5 mins or 30 SECS", [(3900, "1 hour 5 mins"), (30, "30 SECS")]),
        ("0 minutes, 10minutes, ten minutes", []),
        ("10 to about 20 minutes", [(1200, "10 to about 20 minutes")]),
    ],
)
def test_times_by_hand(text, want):
    assert [t[:2] for t in texts.times(text)] == want


BLOB = "Creamy bake here is how to make it now Salt and oil, to taste 1lb pasta of choice 1/2 cup sun-dried tomatoes + oil 1 tbsp butter 1/2 yellow onion, diced 6-8 cloves of garlic 2 eggs heat at 350 degrees for 20 minutes 1-2 cups broccoli"


def test_lines_of_ingredients_are_cut(spark):
    cut = lambda t: spark.createDataFrame([(t,)], "t string").select(texts.split_blob(F.col("t"))).first()[0]
    assert cut(BLOB) == [
        "Creamy bake here is how to make it now", "Salt and oil, to taste", "1lb pasta of choice", "1/2 cup sun-dried tomatoes + oil", "1 tbsp butter", "1/2 yellow onion, diced", "6-8 cloves of garlic",
        "2 eggs heat at 350 degrees for 20 minutes", "1-2 cups broccoli",
    ]
    for same in ("1 cup milk 2 cups flour 3 tbsp oil", "Take 1 cup of milk and then walk for two hours along the river until you come to a bridge", "x" * 100, "1 cup " * 2 + "y" * 90):
        assert cut(same) == [same]


def read(spark, text):
    rows = texts.text_recipes(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos", "part", "k").collect()
    return [(r.kind, r.text) for r in rows]


def test_sections_of_text(spark):
    assert read(spark, "Title: Pie\r\n\nIngredients:\n- 1 egg\n2. milk\nPlan Meal\n<button>\nDirections\n1. Mix.\nBake it. It is good. Serve warm.\n") == [
        ("title", "Pie"), ("ingredient", "1 egg"), ("ingredient", "milk"), ("step", "Mix."), ("step", "Bake it"), ("step", "Serve warm")]
    assert read(spark, "= Ingredients\negg") == [("title", "Pasted Recipe"), ("ingredient", "egg")]
    assert read(spark, "Stew\n• beans\n1/2 onion\nParsley for garnish\n1. Wash\nStir the beans on low heat. Wait a bit\nserve\nI like it") == [
        ("title", "Stew"), ("ingredient", "beans"), ("ingredient", "1/2 onion"), ("ingredient", "Parsley for garnish"), ("step", "Wash"), ("step", "Stir the beans on low heat")]
    assert read(spark, "") == [] and read(spark, None) == [] and read(spark, " \n ") == []
    assert [k for k, _ in read(spark, "Pasta\n" + BLOB)].count("ingredient") >= 7


def test_likely_ingredients_and_steps(spark):
    likely = {"1lb chicken": True, "6-8 oz cheese": True, "½ cup oil": True, "1/2 yellow onion": True, "3 tomatoes": True, "2 large eggs": True, "Salt, to taste": True, "3 stir the pot": False, "salt": False, "1 " + "x" * 70: False, "to taste " * 10: False, "4 gnomes": True}
    for t, want in likely.items():
        assert spark.createDataFrame([(t,)], "t string").select(F.expr(T.likely_ingredient(SPARK, "t"))).first()[0] is want, t
    steps = {"Place in a bowl and wait": True, "let  sit for an hour or so": True, "serve": False, "The weather was good today": False, "Bring to a boil, slowly now": True}
    for t, want in steps.items():
        assert spark.createDataFrame([(t,)], "t string").select(F.expr(T.reads_like_step(SPARK, "t"))).first()[0] is want, t


def test_captions_are_cleaned(spark):
    clean = lambda t: spark.createDataFrame([(t,)], "t string").select(F.expr(T.clean_caption(SPARK, "t"))).first()[0]
    assert clean("Soup #yum\n😀🍲 \n•••───\n= = =\n\n\n\nStir\nFollow me now\nplease comment PIE and I'll send\nComment soup we send it\n𝐁𝐨𝐥𝐝 end ") == "Soup \n\nStir\n\nplease \n\n end" or clean("a #b\n😀\nc") == "a \nc"
    assert clean("follows me") == "follows me" and clean("1 😀 egg") == "1 😀 egg" and clean("--- x") == "--- x"


def test_share_links_drop_the_least(spark):
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefghij klmnop qrstuv") for _ in range(n))
    rows = []
    for k in range(40):
        size = lambda: rng.choice([0, 50, 400, 3000, 6000])
        rows.append((k, noise(20), [noise(rng.choice([20, 900])) for _ in range(rng.randrange(1, 5))], ["Mix."], noise(size()) or None, noise(size()) or None, [noise(30)] * 2, [noise(300)], [], noise(size()) or None, noise(60)))
    df = spark.createDataFrame(rows, "i long, title string, ingredients array<string>, steps array<string>, description string, image_url string, keywords array<string>, cuisines array<string>, categories array<string>, source_url string, author string")
    df = df.withColumn("nutrition", F.when(F.col("i") % 2 == 0, F.struct(F.lit(1.5).alias("cal"), F.lit(None).cast("double").alias("fat"))))
    order = ["d", "n", "img", "kw", "cu", "cat", "src", "a"]
    for short, most, drops in ((False, 6000, 3), (True, 2900, 8)):
        for r in payloads.fit_share_link(df, "https://x/#", short=short).collect():
            whole = {"t": r.title, "a": r.author, "d": r.description, "img": r.image_url, "ig": r.ingredients, "st": r.steps, "n": {"cal": 1.5} if r.nutrition else None, "kw": r.keywords, "cu": r.cuisines, "cat": r.categories or None, "src": r.source_url}
            made = []
            for k in range(drops + 1):
                part = {a: b for a, b in whole.items() if b is not None and a not in order[:k]}
                packed = base64.urlsafe_b64encode(gzip.compress(json.dumps(part, ensure_ascii=False, separators=(",", ":")).encode(), 9, mtime=0)).rstrip(b"=")
                made.append((len("https://x/#") + len(packed), part))
            fits = [(k, p) for k, (n, p) in enumerate(made) if n <= most]
            want = fits[0] if fits else (None, None) if short else (drops, made[-1][1])
            assert (r.dropped, r.link is None) == (want[0], want[0] is None)
            if r.link:
                packed = r.link.removeprefix("https://x/#")
                assert json.loads(gzip.decompress(base64.urlsafe_b64decode(packed + "=" * (-len(packed) % 4)))) == want[1]


def test_large_members_of_archives(spark):
    big = json.dumps({"name": "x" * (17 << 20)}).encode()
    whole = b"\x1f\x8b" * 2000 + gzip.compress(big) + b"noise" + gzip.compress(b'{"name": "b"}')
    assert [len(m) for m in payloads.members(whole)] == [len(big), 13]


def test_a_line_is_searched_for_verbs_once_where_its_kind_hangs_on_them(spark):
    docs = spark.createDataFrame([(1, "Soup\n 1 cup milk  \nSteps\n Stir it. Serve it hot. ")], "doc_id long, text string")
    found = texts.text_recipes(docs)
    assert [(r.kind, r.text) for r in found.orderBy("pos", "part", "k").collect()] == [("title", "Soup"), ("ingredient", "1 cup milk"), ("step", "Stir it"), ("step", "Serve it hot")]
    nodes = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "marinate" in line]
    assert len(nodes) == 1 and "Filter" not in nodes[0]
