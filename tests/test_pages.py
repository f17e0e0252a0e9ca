"""Shapes of recipe pages: JSON-LD, nested microdata, sections under headings; references in texts."""

import html
import html.entities
import json

import pytest
from pyspark.sql import functions as F

from larder.operators import entities, pages, trees

TYPE = 'itemscope itemtype="https://schema.org/Recipe"'


def micro(text):
    return trees.microdata(trees.tree(text))


def under(text):
    return trees.headings(trees.tree(text))


def test_microdata_values_by_tag():
    (found,) = micro(
        f"""<div {TYPE}><meta itemprop=name content=Pie><img itemprop=image src=a.png content=b.png><a itemprop=url href=/x>text</a>
        <time itemprop=cookTime datetime=PT1H>an hour</time><time itemprop=prepTime>PT5M</time><data itemprop=recipeYield value=6>six</data>
        <link itemprop=sameAs href=l><p itemprop=description> A <b>good</b> pie </p><img itemprop=empty></div>"""
    )
    assert found == {"name": "Pie", "image": "a.png", "url": "/x", "cookTime": "PT1H", "prepTime": "PT5M", "recipeYield": "6", "sameAs": "l", "description": "A good pie", "empty": "", "@type": "Recipe"}


def test_microdata_scopes_nest():
    (found,) = micro(
        f"""<div {TYPE}><div><span itemprop=author itemscope itemtype="http://schema.org/Person"><b itemprop=name>Ann</b></span></div>
        <div itemprop=nutrition itemscope itemtype="http://schema.org/NutritionInformation"><i itemprop=calories>250 kcal</i>
        <div itemprop=part itemscope><i itemprop=x>1</i></div></div><div itemscope><i itemprop=hidden>other item</i></div><i itemprop=last>z</i></div>"""
    )
    assert found == {"author": {"@type": "Person", "name": "Ann"}, "nutrition": {"@type": "NutritionInformation", "calories": "250 kcal", "part": {"x": "1"}}, "last": "z", "@type": "Recipe"}


def test_microdata_repeats_and_several_names():
    (found,) = micro(f'<ul {TYPE}><li itemprop="recipeIngredient ingredients">1 egg<li itemprop=recipeIngredient>2 cups <b>milk</b><li itemprop=keywords>a<li itemprop=keywords>b<li itemprop=recipeInstructions>Mix</ul>')
    assert found == {"recipeIngredient": ["1 egg", "2 cups milk"], "ingredients": ["1 egg"], "keywords": ["a", "b"], "recipeInstructions": ["Mix"], "@type": "Recipe"}


def test_microdata_of_several_scopes_on_a_page():
    found = micro(f"<div {TYPE}><i itemprop=name>A</i><div itemprop=variant {TYPE}><i itemprop=name>B</i></div></div><p><div {TYPE}><i itemprop=name>C")
    assert [x["name"] for x in found] == ["A", "B", "C"] and found[0]["variant"] == {"@type": "Recipe", "name": "B"}
    assert micro("<div itemscope itemtype='https://schema.org/Person'><i itemprop=name>A</i></div>") == [] and micro("") == []


def test_microdata_takes_no_properties_inside_a_value():
    (found,) = micro(f"<div {TYPE}><li itemprop=recipeIngredient><span itemprop=amount>1</span> <span itemprop=name>egg</span></li></div>")
    assert found == {"recipeIngredient": ["1 egg"], "@type": "Recipe"}


def test_trees_end_what_is_left_open():
    page = trees.tree("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>x<p>y<div>z</p></div><table><tr><td>1<td>2<tr><td>3</table></nothing><br/>end")
    shape = lambda x: [c if isinstance(c, str) else (c.tag, *shape(c)) for c in x.parts]
    assert shape(page) == [("ul", ("li", "a"), ("li", "b", ("ul", ("li", "c"))), ("li", "d")), ("p", "x"), ("p", "y"), ("div", "z"), ("table", ("tr", ("td", "1"), ("td", "2")), ("tr", ("td", "3"))), ("br",), "end"]
    deep = trees.tree("<div>" * 30_000 + "x")
    assert deep.text() == "x" and sum(1 for _ in deep.within()) == 30_000


def test_sections_end_at_a_heading_of_the_same_or_a_higher_rank():
    found = under("<h1>Pie</h1><h2>Ingredients:</h2><ul><li>1 egg<li>milk</ul><h2>About</h2><ul><li>no</ul><h3>Directions</h3><p>Bake.</p><h2>x</h2><p>no</p>")
    assert found["name"] == "Pie" and found["recipeIngredient"] == ["1 egg", "milk"] and [s["text"] for s in found["recipeInstructions"]] == ["Bake."]


@pytest.mark.parametrize("stop", ["Notes", "🍽 Serving", "Tips and tricks", "Nutrition", "You  may also like", "Leave a reply", "Print", "Latest posts"])
def test_lower_headings_end_a_section_only_if_they_are_stops(stop):
    found = under(f"<h2>How to make it</h2><p>Mix.</p><h3>The oven</h3><p>Bake.</p><h4>{stop}</h4><p>no</p>")
    assert [s["text"] for s in found["recipeInstructions"]] == ["Mix.", "The oven: Bake."]


def test_lines_sub_headings_and_lists_of_steps():
    found = under("<h2>Method</h2><h3>1. Cook the beef</h3><p>Heat.<br>Fry &amp; <b>stir.<br/>Turn.</b></p><h3>2. Rest</h3><ol><li>Wait<li>Serve</ol><div><p>not a sibling</p></div><p>eat</p>")
    assert [s["text"] for s in found["recipeInstructions"]] == ["Cook the beef: Heat.", "Fry & stir.", "Turn.", "Rest: Wait", "Serve", "eat"]


def test_script_text_and_other_elements_are_left_out():
    found = under("<h2>ingredients</h2><p>not a list</p><ul><li>1 egg<li>ezstandalone.cmd<li>&nbsp;</ul><section><ul><li>inside</ul></section><h2>steps</h2><p>a googletag b</p><p>Mix.</p>")
    assert found["recipeIngredient"] == ["1 egg"] and [s["text"] for s in found["recipeInstructions"]] == ["Mix."]


def test_titles_and_pictures_of_heading_pages():
    assert under("<title>Best pie | Site</title><meta property=og:image content=p.png><h2>Ingredients</h2><ol><li>egg</ol>") | {"recipeIngredient": 0} == {"@type": "Recipe", "name": "Best pie", "image": "p.png", "recipeIngredient": 0, "recipeInstructions": []}
    assert under("<h4>Steps</h4><p>Mix.")["name"] == "Untitled Recipe"
    assert under("<h2>Ingredients</h2><p>none") is None and under("<h5>Ingredients</h5><ul><li>x</ul>") is None


def best(spark, *bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "page_id long, html string")
    return {r.page_id: r for r in pages.best_layer(df).collect()}


def ld(x):
    return f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>'


def test_whole_recipes(spark):
    whole = {
        "@type": ["Recipe"], "name": "Pie &amp; more", "author": [{"name": "Ann"}, {"name": "Bob"}], "description": "d&eacute;lice", "image": [{"url": "u.png"}], "recipeYield": ["6 servings", "x"],
        "prepTime": "PT10M", "cookTime": "PT1H", "totalTime": "P1DT70M", "recipeIngredient": ["1 &frac12; egg", {"text": "milk"}, " "], "keywords": "easy, , dinner ", "recipeCuisine": ["French"], "recipeCategory": "Dessert",
        "nutrition": {"@type": "NutritionInformation", "calories": "250 kcal", "fatContent": "9.5 g", "sodiumContent": 3},
        "recipeInstructions": [{"@type": "HowToSection", "name": "Dough", "itemListElement": [{"text": "Knead it"}, "Let it rest", {"name": "no text"}]}, {"@type": "HowToStep", "name": "name only"}, {"text": "Bake it"}, "This is good"],
    }
    rows = best(
        spark,
        ld(whole),
        ld({"@graph": [{"@type": "Recipe", "name": "stub"}, {"@type": "https://schema.org/Recipe", "author": "Cy", "image": "", "recipeInstructions": "1. Mix it\n\n2. Heat it"}]}) + '<meta content="og.png" property="og:image">',
        ld("{broken") + f"<div {TYPE}><b itemprop=author itemscope><i itemprop=name>Di</i></b><i itemprop=recipeYield>4</i><i itemprop=recipeIngredient>egg</i></div>",
        ld({"@type": "Person"}) + "<h2>Directions</h2><p>Mix it.<p>Bake it.",
        None,
        "",
        "<p>nothing</p>",
        ld([{"@type": "Recipe", "recipeInstructions": ["Mix it well. Heat it! 2.5 hours on low. then wait"]}]),
    )
    a = rows[0]
    assert (a.layer, a.title, a.author, a.description, a.image, a.servings_text, a.servings, a.prep_minutes, a.cook_minutes, a.total_minutes) == ("jsonld", "Pie & more", "Ann", "délice", "u.png", "6 servings", 6, 10, 60, 1510)
    assert a.ingredients == ["1 ½ egg", "milk"] and a.steps == ["[Dough]", "Knead it", "Let it rest", "Bake it"]
    assert a.keywords == ["easy", "dinner"] and a.cuisines == ["French"] and a.categories == ["Dessert"] and a.tags == "lunch/dinner,dessert"
    assert a.nutrition.asDict() == {"calories": 250.0, "fat_g": 9.5, "saturated_fat_g": None, "carbohydrate_g": None, "fiber_g": None, "sugar_g": None, "protein_g": None, "cholesterol_mg": None, "sodium_mg": 3.0}
    assert (rows[1].title, rows[1].author, rows[1].image, rows[1].steps, rows[1].nutrition) == ("Untitled Recipe", "Cy", "og.png", ["Mix it", "Heat it"], None)
    assert (rows[2].layer, rows[2].author, rows[2].servings, rows[2].ingredients) == ("microdata", "Di", 4, ["egg"])
    assert (rows[3].layer, rows[3].steps) == ("heuristic", ["Mix it.", "Bake it."])
    assert rows[7].steps == ["Mix it well.", "Heat it! 2.5 hours on low. then wait"]
    assert set(rows) == {0, 1, 2, 3, 7}


def test_lite_recipes_read_other_fields(spark):
    raw = spark.createDataFrame([(1, "x", json.dumps({"headline": "H", "ingredients": ["egg"]}))], "page_id long, layer string, json string")
    assert [(r.title, r.ingredients) for r in pages.normalized(raw, lite=True).collect()] == [("H", ["egg"])]
    assert [(r.title, r.ingredients) for r in pages.normalized(raw).collect()] == [("Untitled Recipe", [])]


def test_references_equal_the_standard_table(spark):
    texts = [f"a &{n} b &{n}x" for n in html.entities.html5] + [f"&#{n};&#x{n:x} &#{n}z" for n in [0, 1, 9, 38, 128, 150, 159, 955, 0xD800, 0x1F600, 0x110000]] + [None, "", "a & b", "&;&#;&#x;", "&notit;&amp;lt;"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", entities.decode(F.col("t")).alias("plain")).collect()
    assert {r.i: r.plain for r in rows} == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}
    lists = spark.createDataFrame([(["&amp;", "b"],), ([],), (None,), ([""],)], "x array<string>")
    assert [r.x for r in entities.decoded(lists, "x").collect()] == [["&", "b"], [], None, [""]]
