"""Posts, transcripts and exports: choosing the text that a recipe is read from."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .texts import QUANTITY, VERB

WINDOW = 5_000


def drop_blocked_domains(df: DataFrame, domains: DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """Df without rows whose host is one of domains (domain) or below one.

    A host has as many suffixes as labels; they meet the list by equality, so the list may be of any size.
    """
    labels = F.split(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = df.select(key, F.explode(suffixes).alias("domain")).join(domains.select("domain"), "domain", "left_semi")
    return df.join(hits.select(key), key, "left_anti")


def post_text_by_code(html: Column, code: Column) -> Column:
    """The first long text in the script that names the post, else near the post's name; null without the name."""
    pattern = r'"text"\s*:\s*"((?:[^"\\]++|\\.)*+)"'
    scripts = F.filter(F.regexp_extract_all(html, F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1)), lambda s: F.contains(s, code))
    at = F.position(code, html)
    near = F.when(at > 0, F.substring(html, F.greatest(at - WINDOW, F.lit(1)), F.lit(2 * WINDOW)))
    return F.coalesce(F.nullif(F.regexp_extract(F.get(scripts, F.lit(0)), pattern, 1), F.lit("")), F.nullif(F.regexp_extract(near, pattern, 1), F.lit("")))


def short_video_caption(html: Column) -> Column:
    """The longest "desc" of 50 characters or more in a page's data, of equal ones the first in order; else its og:description."""
    found = F.filter(F.regexp_extract_all(html, F.lit(r'"desc"\s*:\s*"((?:[^"\\]++|\\.)*+)"'), F.lit(1)), lambda s: F.length(s) >= 50)
    best = F.get(F.array_sort(F.transform(found, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s")))), F.lit(0))
    return F.coalesce(best["s"], F.nullif(F.regexp_extract(html, r'<meta property="og:description" content="([^"]*)"', 1), F.lit("")))


def best_text(df: DataFrame, key: str) -> DataFrame:
    """(key, source, text) of the best of a post's texts (caption, transcript, ocr).

    The caption with the transcript, then with the screen text, each only with quantities and verbs; then the
    transcript, then the screen text, with either.
    """
    both = lambda t: t.rlike("(?m)" + QUANTITY) & t.rlike(VERB)
    either = lambda t: t.rlike("(?m)" + QUANTITY) | t.rlike(VERB)
    joined = {"caption+transcript": F.concat_ws("\n", "caption", "transcript"), "caption+ocr": F.concat_ws("\n", "caption", "ocr")}
    rules = [(F.when(both(t), t), k) for k, t in joined.items()] + [(F.when(either(F.col(c)), F.col(c)), c) for c in ("transcript", "ocr")]
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("source"), t.alias("text")) for t, k in rules]), lambda x: x["text"].isNotNull())
    return df.select(key, F.get(found, F.lit(0)).alias("best")).where("best is not null").select(key, "best.*")


def balanced_object(text: str, marker: str) -> str | None:
    """The JSON object that starts after marker, to its closing brace; braces in strings do not count."""
    start = text.find("{", max(0, text.find(marker)))
    if marker not in text or start < 0:
        return None
    depth, quoted, skip = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


@pandas_udf(StringType())
def player_object(pages: pd.Series) -> pd.Series:
    def one(page):
        found = balanced_object(page or "", "playerResponse")
        try:
            return json.dumps(json.loads(found)) if found else None
        except ValueError:
            return None

    return pages.map(one)


def pick_caption_track(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, track): the address of the English caption track, else of the first, else a description of 80 characters or more."""
    v = df.select(key, F.try_parse_json(player_object(html)).alias("v"))
    tracks = F.expr("try_variant_get(v, '$.captions.tracks', 'array<variant>')")
    english = F.get(F.filter(tracks, lambda t: F.get_json_object(F.to_json(t), "$.lang") == "en"), F.lit(0))
    best = F.coalesce(english, F.get(tracks, F.lit(0)))
    about = F.expr("try_variant_get(v, '$.about', 'string')")
    return v.select(key, F.coalesce(F.get_json_object(F.to_json(best), "$.url"), F.when(F.length(about) >= 80, about)).alias("track"))


def tabular_exports(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, text) of exports that start with a marker line: the next line is the title, short lines
    without a verb are ingredients until the first step, attribution and what follows the end marker is left out.

    All in the row: a document's lines are an array, so nothing is shuffled.
    """
    rows = F.filter(F.transform(F.split("text", r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    known = docs.withColumn("l", rows).where(F.get("l", F.lit(0)).rlike(r"(?i)^\*?\s*exported from"))
    ended = known.withColumn("last", F.expr("coalesce(nullif(array_position(transform(l, s -> s rlike '^- - -'), true), 0), size(l) + 1)"))
    body = ended.withColumn("title", F.get("l", F.lit(1))).withColumn("b", F.expr("filter(slice(l, 3, greatest(last - 3, 0)), s -> not lower(s) rlike '^(recipe by|serving size|amount|[- ]+$)')"))
    step = F.expr(f"coalesce(nullif(array_position(transform(b, s -> length(s) > 60 or s rlike '{VERB.replace(chr(92), chr(92) * 2)}'), true), 0), size(b) + 1)")
    split = body.withColumn("first", step)
    parts = F.expr(
        "concat(array(struct('title' as kind, title as text)), transform(slice(b, 1, first - 1), s -> struct('ingredient' as kind, replace(s, ' -- ', ', ') as text)),"
        " transform(slice(b, first, greatest(size(b) - first + 1, 0)), s -> struct('step' as kind, s as text)))"
    )
    return split.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.*")
