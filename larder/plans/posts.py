"""Queries over posts, transcripts, exports, archives and a stream of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import posts as P
from larder.sources import payloads as S
from larder.sources.folders import shared
from larder.streaming import jobs as J

from .extraction import LAYER, RECIPE, WORDS


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_drop_blocked(spark, sf_dir):
    domains = spark.createDataFrame([("example.org",), ("blog.thertion.example.com",), ("net",)], "domain string")
    return P.drop_blocked_domains(_read(spark, sf_dir, "pages").select("page_id", "url"), domains)


def x16_post_text_by_code(spark, sf_dir):
    code = F.concat(F.lit("Q"), F.col("page_id").cast("string"), F.lit("Q"))
    html = F.expr("""concat('<script>{"text": "other"}</script><script>', case when page_id % 2 = 0 then concat('{"id": "Q', page_id, 'Q", "text": "bean soup ', page_id, '"}') else '' end, '</script>', html)""")
    return _read(spark, sf_dir, "pages").select("page_id", P.post_text_by_code(html, code).alias("text"))


def x20_best_text(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    texts = pages.select(
        "page_id",
        F.when(F.col("page_id") % 2 == 0, "2 cups beans").otherwise("look at this").alias("caption"),
        F.when(F.col("page_id") % 3 == 0, "stir the beans").alias("transcript"),
        F.when(F.col("page_id") % 5 == 0, "boil for an hour").alias("ocr"),
    )
    return P.best_text(texts, "page_id").select("page_id", "source")


def x24_image_recipe(spark, sf_dir):
    """Manual and image forms: titles, trimmed lines, and the sum of both times where no total is given."""
    orders = _read(spark, sf_dir, "orders")
    prep, cook = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 30), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 50)
    total = F.when(prep.isNotNull() | cook.isNotNull(), F.coalesce(prep, F.lit(0)) + F.coalesce(cook, F.lit(0)))
    return orders.select("o_orderkey", F.coalesce(F.nullif(F.trim(F.col("o_orderpriority")), F.lit("")), F.lit("Untitled")).alias("title"), total.alias("minutes"))


def x26_caption_track(spark, sf_dir):
    html = F.expr("""concat('x = {}; playerResponse = {"about": "', repeat('so good ', 12), '", "captions": {"tracks": [', case page_id % 3 when 0 then '{"lang": "fr", "url": "f}"}, {"lang": "en", "url": "e"}' when 1 then '{"lang": "de", "url": "d"}' else '' end, ']}}; more {', html)""")
    return P.pick_caption_track(_read(spark, sf_dir, "pages").select("page_id", html.alias("html")), "page_id")


def t6_tabular_export(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    text = F.expr("concat('* Exported from Kitchen *\\n\\n  Soup ', doc_id, '\\nRecipe By: x\\n2 cups beans -- dried\\n1 tsp salt\\nBoil the beans.\\nServe.\\n- - - - -\\nlater')")
    return P.tabular_exports(docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, text).otherwise(F.col("text")).alias("text")))


def s3_archives(spark, sf_dir):
    one = S.pack(F.to_json(F.struct(F.col("source").alias("name"), F.col("doc_id"))))
    raw = F.unbase64(F.translate(F.concat(one, F.repeat(F.lit("="), F.pmod(-F.length(one), F.lit(4)))), "-_", "+/"))
    files = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(raw, F.lit("noise").cast("binary"), raw).alias("content"))
    return S.read_archives(files).select("path", F.get_json_object("json", "$.name").alias("name"))


def r1_stream_extract(spark, sf_dir):
    path = f"{sf_dir}/pages.parquet"
    pages = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("n", F.col("page_id").cast("string")).withColumn("w", F.expr(WORDS))
    built = pages.select("page_id", F.expr(f"concat({RECIPE}, html)").alias("html"))
    return J.extract(built, shared(spark)).select("page_id", "layer", "title")


QUERIES = {f.__name__: f for f in (p2_drop_blocked, x16_post_text_by_code, x20_best_text, x24_image_recipe, x26_caption_track, t6_tabular_export, s3_archives, r1_stream_extract)}
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"
ORACLE_SQL = {
    "p2_drop_blocked": "select page_id, url from pages where not (" + " or ".join(f"{_HOST} = '{d}' or {_HOST} like '%.{d}'" for d in ("example.org", "blog.thertion.example.com", "net")) + ")",
    "x16_post_text_by_code": "select page_id, case when page_id % 2 = 0 then 'bean soup ' || page_id end as text from pages",
    "x20_best_text": "select page_id, case when page_id % 6 = 0 then 'caption+transcript' when page_id % 10 = 0 then 'caption+ocr' when page_id % 3 = 0 then 'transcript' else 'ocr' end as source from pages where page_id % 3 = 0 or page_id % 5 = 0",
    "x24_image_recipe": "select o_orderkey, o_orderpriority as title, case when o_orderkey % 3 <> 0 or o_orderkey % 4 <> 0 then (case when o_orderkey % 3 <> 0 then o_orderkey % 30 else 0 end) + (case when o_orderkey % 4 <> 0 then o_orderkey % 50 else 0 end) end as minutes from orders",
    "x26_caption_track": "select page_id, case page_id % 3 when 0 then 'e' when 1 then 'd' else repeat('so good ', 12) end as track from pages",
    "t6_tabular_export": "select doc_id, unnest(['title', 'ingredient', 'ingredient', 'step', 'step']) as kind, unnest(['Soup ' || doc_id, '2 cups beans, dried', '1 tsp salt', 'Boil the beans.', 'Serve.']) as text from documents where doc_id % 2 = 0",
    "s3_archives": "select cast(doc_id as varchar) as path, source as name from documents union all select cast(doc_id as varchar), source from documents",
    "r1_stream_extract": f"select page_id, {LAYER} as layer, 'Recipe ' || page_id || ' & more' as title from pages",
}
