"""Free-text recipes: lines of documents with their section, by windows inside a document."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.functions import text as T
from larder.functions.dialect import SPARK
from larder.operators.entities import decode

#: How header lines of the two sections begin, and buttons and labels of pages that get into a text.
INGREDIENT_HEADER = r"^(?:=\s*)?(?:ingredients|grocery\s*list)\b"
STEP_HEADER = r"^(?:instructions|steps|directions|method)\b"
ANY_HEADER = r"^(?:=\s*)?(?:ingredients|grocery\s*list|instructions|steps|directions|method)\b"
ARTIFACT = r"^(?:[®<>\[\]]|do category|addo list|plan meal)"
UNTITLED = "Pasted Recipe"
BULLET, NUMBERED = r"^[-*•]\s", r"^[0-9]+\.\s"
#: A line is cut only if it is longer, and has so many amounts with a unit.
BLOB_LONGER, BLOB_AMOUNTS = 80, 3
QUANTITY = rf"^\s*{T.AMOUNT}\s*(?:{T.any_of(T.units_after_number())})\b"
VERB = rf"(?i)\b(?:{T.any_of(T.VERBS)})\b"
TIMES = "degrees?|minutes?|mins?|hours?|hrs?|seconds?|secs?"


def _trim(x: Column) -> Column:
    """x without white space at its ends; the pattern goes through a text only if its first or last character is white space."""
    ends = F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1)))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).otherwise(x)


def _pieces(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, "\n"), _trim), lambda p: p != "")


def split_blob(line: Column) -> Column:
    """The ingredients of a long line that has three amounts with a unit or more; else the line.

    It is cut before amounts with a unit, fractions and numbers before a word (but for times and
    temperatures), then pieces that do not begin with an amount before the words that are "to taste" and the like.
    """
    measured = rf"{T.AMOUNT}\s*(?:{T.any_of(T.units_after_number(), chr(92) + 's*')})\b"
    cut = line
    for found in (rf"({measured})", r"([0-9]+/[0-9]+\s+[a-z])", rf"([0-9]+[-0-9]*\s+(?!(?:{TIMES})\b)[a-z])"):
        cut = F.regexp_replace(cut, rf"(?i)\s{found}", "\n$1")
    qualified = rf"(?i)([A-Za-z0-9_])\s+(\S+(?:\s+and\s+\S+)?[,\s]+(?:{T.any_of(T.QUALIFIERS, chr(92) + 's+')}))"
    parts = F.flatten(F.transform(_pieces(cut), lambda p: F.when(p.rlike("^[0-9½¼¾⅓⅔]"), F.array(p)).otherwise(_pieces(F.regexp_replace(p, qualified, "$1\n$2")))))
    many = (F.length(line) > BLOB_LONGER) & (F.regexp_count(line, F.lit(f"(?i){measured}")) >= BLOB_AMOUNTS)
    return F.when(many & (F.size(parts) > 1), parts).otherwise(F.array(line))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, part, line, bare) of every line with text, long ones cut; bare is trimmed.

    Arrays are exploded as outer ones, else Spark makes them twice, first for a filter on their size.
    """
    rows = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("bare", _trim(F.col("line"))).where("bare <> ''").withColumn("parts", split_blob(F.col("bare")))
    cut = rows.select("doc_id", "pos", F.when(F.size("parts") > 1, F.col("parts")).otherwise(F.array("line")).alias("lines"))
    return cut.select("doc_id", "pos", F.posexplode_outer("lines").alias("part", "line")).withColumn("bare", _trim(F.col("line")))


def sections(rows: DataFrame) -> DataFrame:
    """Rows with is_first, is_header and section, the last header at or before them; a document's lines are sorted in its own partition group."""
    low = F.lower("bare")
    ordered = Window.partitionBy("doc_id").orderBy("pos", "part")
    placed = rows.withColumn("is_first", F.row_number().over(ordered) == 1)
    titled = F.col("is_first") & ~low.rlike(ANY_HEADER)
    own = F.when(titled, None).when(low.rlike(INGREDIENT_HEADER), "ingredients").when(low.rlike(STEP_HEADER), "steps")
    marked = placed.withColumn("is_title", titled).withColumn("own", own).withColumn("is_header", own.isNotNull())
    return marked.withColumn("section", F.last("own", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("own")


def text_recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, part, k, kind, text): title, ingredient and step rows of documents (doc_id, text), in the order of pos, part, k.

    The first line that is no header is the title. Under a header lines are what it says: steps that
    are not numbered are cut into sentences, of which those with a cooking verb stay. Before any header bullets and likely ingredients are
    ingredients, numbered lines and long ones with a verb steps. Labels and buttons are skipped.
    """
    known = sections(lines(docs))
    cleaned = _trim(F.regexp_replace(F.regexp_replace("line", r"^[-*•]\s*", ""), r"^[0-9]+\.\s*", ""))
    title = _trim(F.regexp_replace(F.regexp_replace("line", r"^[<®=\-\[\]0-9.]+\s*", ""), r"(?i)^Title:\s*", ""))
    rows = known.withColumn("clean", cleaned).withColumn("title", title)
    cut = F.filter(F.transform(F.split("clean", r"\.\s+(?=[A-Z])"), lambda s: _trim(F.regexp_replace(_trim(s), r"\.$", ""))), lambda s: s != "")
    # made in the branches that ask for it, not for every line; a line without a cooking verb has no sentence with one
    told = F.filter(F.when(F.size(cut) > 0, cut).otherwise(F.array("clean")), lambda s: F.rlike(F.lower(s), F.lit(T.VERB_WORD)))
    numbered, bullet = F.col("bare").rlike(NUMBERED), F.col("bare").rlike(BULLET)
    likely = F.expr(T.likely_ingredient(SPARK, "clean"))
    said = lambda kind, texts: F.transform(texts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))
    none = F.expr("cast(array() as array<struct<kind: string, text: string>>)")
    content = (
        F.when(F.col("is_title") | F.col("is_header") | F.lower("bare").rlike(ARTIFACT) | (F.col("clean") == ""), none)
        .when(F.col("section") == "ingredients", said("ingredient", F.array("clean")))
        .when(F.col("section") == "steps", said("step", F.when(numbered, F.array("clean")).otherwise(told)))
        .when(bullet | likely, said("ingredient", F.array("clean")))
        .when(numbered, said("step", F.array("clean")))
        .when(F.length("clean") > T.STEP_LONGER, said("step", told))
        .otherwise(none)
    )
    heading = F.when(F.col("is_title"), said("title", F.array("title"))).when(F.col("is_first"), said("title", F.array(F.lit(UNTITLED)))).otherwise(none)
    return rows.select("doc_id", "pos", "part", F.posexplode_outer(F.concat(heading, content)).alias("k", "x")).where("k is not null").select("doc_id", "pos", "part", "k", "x.kind", "x.text")


#: Where a page's data has texts and captions, and how long those must be.
TEXT_VALUE, TEXT_LEAST = r'"text"\s*:\s*"((?:[^"\\]++|\\.)*+)"', 100
CAPTION_VALUE, CAPTION_LEAST = r'"caption"\s*:\s*\{[^}]*?"text"\s*:\s*"((?:[^"\\]++|\\.)*+)"', 50


def _values(html: Column, pattern: str, least: int) -> Column:
    """The values of a pattern, unescaped (D7), different ones of some length, longest first, of equal ones the earlier."""
    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    plain = F.transform(found, lambda s: F.coalesce(F.get_json_object(F.concat(F.lit('{"a":"'), s, F.lit('"}')), "$.a"), s))
    long = F.array_distinct(F.filter(plain, lambda s: F.length(s) >= least))
    return F.transform(F.array_sort(F.transform(long, lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s")))), lambda x: x["s"])


def captions(html: Column) -> Column:
    """The texts in a page's data, longest first."""
    return _values(html, TEXT_VALUE, TEXT_LEAST)


def post_text(html: Column) -> Column:
    """A post's text: the longest caption, else the longest text."""
    return F.coalesce(F.get(_values(html, CAPTION_VALUE, CAPTION_LEAST), F.lit(0)), F.get(captions(html), F.lit(0)))


#: Seconds by the first letter of a unit, units, words that say "about", and the forms of a time, the stronger one first.
SECONDS = {"h": 3600, "m": 60, "s": 1}
UNIT = "minutes?|mins?|hours?|hrs?|seconds?|secs?"
ABOUT = re.compile(r"(?:about|approximately|around)\s+", re.I)
TIME_FORMS = (
    re.compile(rf"([0-9]+)\s+hours?\s+(?:and\s+)?([0-9]+)\s+(?:{UNIT})", re.I),
    re.compile(rf"([0-9]+)\s*(?:to|-)\s*([0-9]+)\s+({UNIT})", re.I),
    re.compile(rf"([0-9]+)\s+({UNIT})", re.I),
)


def number(digits: str) -> int:
    """What digits mean, 10 ** 14 at most."""
    return int(digits) if len(digits) < 15 else 10**14


def times(text: str) -> list[tuple[int, str, int, int]]:
    """(seconds, label, start, end) of the times in a text, by place in code points.

    Hours with minutes come before ranges, which mean their upper end, and those before single times;
    a time that shares a character with one found before is left out.
    """
    plain = ABOUT.sub(lambda m: " " * len(m[0]), text)
    taken, found = bytearray(len(plain)), []
    for form, pattern in enumerate(TIME_FORMS):
        for m in pattern.finditer(plain):
            start, end = m.span()
            if any(taken[start:end]):
                continue
            if form == 0:
                seconds = number(m[1]) * 3600 + number(m[2]) * 60
            else:  # the last number counts, the unit stands behind it
                seconds = number(m[pattern.groups - 1]) * SECONDS[m[pattern.groups][0].lower()]
            if seconds > 0:
                taken[start:end] = b"\1" * (end - start)
                found.append((seconds, text[start:end].strip(), start, end))
    return sorted(found, key=lambda t: t[2])


TIMERS = "array<struct<seconds: bigint, label: string, start: int, end: int>>"


def timers(df: DataFrame, text: str, name: str = "timers") -> DataFrame:
    """Q7: df with its texts' times(). Texts without a digit and a unit do not go to a worker."""

    @F.pandas_udf(StructType.fromDDL(f"t {TIMERS}")["t"].dataType)
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else times(t))

    maybe = F.col(text).rlike("[0-9]") & F.col(text).rlike(f"(?i)(?:{UNIT})")
    found = read(F.when(maybe, F.col(text)))
    empty = F.expr(f"cast(array() as {TIMERS})")
    return df.withColumn(name, F.when(F.col(text).isNotNull(), F.coalesce(found, empty)))


#: Results that count, and characters of a snippet.
MOST_RESULTS, SNIPPET = 12, 200
#: What begins a result, marks an advert, and holds the parts of a result, in the list form and in the table form.
RESULT, ADVERT = r'class="result\s', "result--ad"
LIST_FORM = {
    "link": r'(?s)class="result__a"[^>]*href="([^"]*)"[^>]*>.*?</a>',
    "title": r'(?s)class="result__a"[^>]*href="[^"]*"[^>]*>(.*?)</a>',
    "snippet": r'(?s)class="result__snippet"[^>]*>(.*?)</a>',
    "site": r'(?s)class="result__url"[^>]*>(.*?)<',
}
TABLE_FORM = {
    "link": r'(?s)<a[^>]*href="([^"]+)"[^>]*class="result-link"[^>]*>.*?</a>',
    "title": r'(?s)<a[^>]*href="[^"]+"[^>]*class="result-link"[^>]*>(.*?)</a>',
    "snippet": r'(?s)class="result-snippet"[^>]*>(.*?)</td>',
}


def _plain(x: Column) -> Column:
    """Text without tags and references, white space as one space."""
    return _trim(F.regexp_replace(decode(F.regexp_replace(x, "<[^>]*>", "")), r"(?U)\s+", " "))


def search_results(pages: DataFrame, most: int = MOST_RESULTS) -> DataFrame:
    """(page_id, place, url, title, snippet, site): the first results of each page, adverts and such without title or address left out before counting.

    Results are blocks of a list; on a page without any, rows of a table. The address is that behind a redirect, the site
    what the result shows, else the address' host.
    """
    listed = pages.select("page_id", F.split("html", RESULT).alias("blocks"), "html").withColumn("form", F.when(F.size("blocks") > 1, "list").otherwise("table"))
    cut = F.when(F.col("form") == "list", F.slice("blocks", 2, 1 << 30)).otherwise(F.split("html", "<tr>"))
    blocks = listed.select("page_id", "form", F.posexplode(cut).alias("pos", "block")).where(~((F.col("form") == "list") & F.col("block").contains(ADVERT)))
    part = lambda name: F.when(F.col("form") == "list", F.regexp_extract("block", LIST_FORM[name], 1)).otherwise(F.regexp_extract("block", TABLE_FORM[name], 1))
    shown = F.when(F.col("form") == "list", F.regexp_replace(F.regexp_extract("block", LIST_FORM["site"], 1), r"\s+", ""))
    read = blocks.select("page_id", "form", "pos", part("link").alias("link"), part("title").alias("title"), part("snippet").alias("snippet"), shown.alias("shown")).where("link <> ''")
    behind = F.regexp_extract("link", "uddg=([^&]+)", 1)
    url = F.when((F.col("form") == "list") & (behind != ""), F.try_url_decode(behind)).when(F.col("link").startswith("http"), F.col("link"))
    read = read.withColumn("url", url).withColumn("title", _plain(F.col("title"))).where("url is not null and title <> ''")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    first = read.withColumn("place", place).where(F.col("place") <= most)
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    site = F.coalesce(F.nullif(F.regexp_extract("shown", "^([^/]*)", 1), F.lit("")), host)
    return first.select("page_id", "place", "url", "title", F.substring(_plain(F.col("snippet")), 1, SNIPPET).alias("snippet"), site.alias("site"))
