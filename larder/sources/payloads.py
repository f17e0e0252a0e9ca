"""Share payloads, recipe archives and inbox messages: bytes in and out, Arrow batch by Arrow batch.

Compressed bytes are the one thing that Spark has no function for; everything around it
is columns. Every decoder stops at a size, so that a small payload cannot fill a worker.
"""

from __future__ import annotations

import base64
import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructType

ENCODED_MOST, INFLATED_MOST = 12_000, 256 << 10
LINK_MOST = 6_000
PAYLOAD = "t string, ig array<string>, st array<string>, d string, img string, sv bigint, tt bigint"


def packed(text: str) -> str:
    c = zlib.compressobj(9, zlib.DEFLATED, 31)
    return base64.urlsafe_b64encode(c.compress(text.encode()) + c.flush()).rstrip(b"=").decode()


@pandas_udf(StringType())
def pack(texts: pd.Series) -> pd.Series:
    """gzip, then base64 for URLs without padding; the same text gives the same bytes."""
    return texts.map(packed, na_action="ignore")


@pandas_udf(StringType())
def unpack(texts: pd.Series) -> pd.Series:
    """The text of a packed payload; null if it is not one, or too long, packed or unpacked."""

    def one(text):
        if not text or len(text) > ENCODED_MOST:
            return None
        try:
            raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
            d = zlib.decompressobj(47)
            out = d.decompress(raw, INFLATED_MOST + 1)
            return None if len(out) > INFLATED_MOST or not d.eof else out.decode()
        except (ValueError, zlib.error):
            return None

    return texts.map(one)


#: The short keys of a payload, and the columns that they stand for.
KEYS = {
    "t": "title", "a": "author", "d": "description", "img": "image_url", "sv": "servings", "pt": "prep_minutes", "ct": "cook_minutes", "tt": "total_minutes",
    "ig": "ingredients", "st": "steps", "n": "nutrition", "kw": "keywords", "cu": "cuisines", "cat": "categories", "src": "source_url",
}
#: What a link drops first, what a link of any sort may drop in all, and the lengths of links and of those in square codes.
DROPPED, LINK_DROPS, CODE_MOST = ("d", "n", "img", "kw", "cu", "cat", "src", "a"), 3, 2_900


def payload(df: DataFrame) -> Column:
    """The compact JSON of a recipe's columns; missing ones, and empty lists of words, are left out."""
    plain = lambda k, c: F.when(F.size(c) > 0, F.col(c)) if k in ("kw", "cu", "cat") else F.col(c)
    return F.to_json(F.struct(*[plain(k, c).alias(k) for k, c in KEYS.items() if c in df.columns]))


def share_payloads(recipes: DataFrame) -> DataFrame:
    return recipes.withColumn("encoded", pack(payload(recipes)))


def decode_payloads(df: DataFrame, encoded: str = "encoded") -> DataFrame:
    """Df with recipe, null where the payload has no title or no list of ingredients."""
    read = F.from_json(unpack(F.col(encoded)), PAYLOAD)
    fine = F.col("recipe.t").isNotNull() & F.col("recipe.ig").isNotNull()
    some = F.struct("recipe.t", "recipe.ig", F.coalesce("recipe.st", F.array().cast("array<string>")).alias("st"), "recipe.d", "recipe.img", "recipe.sv", "recipe.tt")
    return df.withColumn("recipe", read).withColumn("recipe", F.when(fine, some))


def fit_share_link(recipes: DataFrame, base: str, most: int | None = None, short: bool = False) -> DataFrame:
    """Recipes with link and dropped: the link that leaves out the fewest of DROPPED, from its start, and fits.

    A link may leave out three fields and be 6,000 characters long; one that does not fit even so is given as it is. The
    short form, for square codes, may leave out all eight and be 2,900 long; if it does not fit there is none.
    """
    most, drops = most or (CODE_MOST if short else LINK_MOST), len(DROPPED) if short else LINK_DROPS

    @pandas_udf(StructType.fromDDL("x struct<link: string, dropped: int>")["x"].dataType)
    def fit(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            fields, link, k = json.loads(text), None, None
            for k in range(drops + 1):
                if k and fields.pop(DROPPED[k - 1], None) is None:
                    continue  # as long as before
                link = base + packed(json.dumps(fields, ensure_ascii=False, separators=(",", ":")))
                if len(link) <= most:
                    break
            else:
                link, k = (None, None) if short else (link, drops)
            rows.append((link, k))
        return pd.DataFrame(rows, columns=["link", "dropped"]).astype({"dropped": "Int32"})

    return recipes.withColumn("_fit", fit(payload(recipes))).withColumns({"link": F.col("_fit.link"), "dropped": F.col("_fit.dropped")}).drop("_fit")


ARCHIVE = "path string, member int, json string"


def read_archives(files: DataFrame) -> DataFrame:
    """S3: (path, member, json) of each gzip member with JSON inside the archives in files (path, content); bad ones are skipped."""

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                rows += [(path, k, text) for k, text in enumerate(members(bytes(content)))]
            yield pd.DataFrame(rows, columns=["path", "member", "json"])

    return files.select("path", "content").mapInPandas(run, ARCHIVE)


#: Bytes that an archive's reader takes at a time.
CHUNK = 1 << 16


def members(content: bytes) -> list[str]:
    """The JSON texts of the gzip members of content, wherever they start and however long they are.

    A member is read in chunks, so that a place that only looks like a start costs one chunk.
    """
    out, view, at = [], memoryview(content), content.find(b"\x1f\x8b")
    while at >= 0:
        d, parts, place = zlib.decompressobj(31), [], at
        after = at + 2
        try:
            while not d.eof and place < len(content):
                parts.append(d.decompress(view[place : place + CHUNK]))
                place += CHUNK
            text = b"".join(parts).decode()
            json.loads(text)
            out.append(text)
            if d.eof:
                after = min(place, len(content)) - len(d.unused_data)
        except (ValueError, zlib.error):
            pass
        at = content.find(b"\x1f\x8b", after)
    return out


def import_inbox(df: DataFrame, message: str = "message") -> DataFrame:
    """Df with title from base64 JSON messages of at most 1,000,000 characters that have a title, name or type."""
    text = F.when(F.length(message) <= 1_000_000, F.decode(F.expr(f"try_to_binary({message}, 'base64')"), "UTF-8"))
    read = df.withColumn("_text", text)
    title = F.coalesce(F.get_json_object("_text", "$.title"), F.get_json_object("_text", "$.name"))
    known = title.isNotNull() | F.get_json_object("_text", "$['@type']").isNotNull()
    return read.withColumn("title", F.when(known, title)).withColumn("accepted", F.coalesce(known, F.lit(False))).drop("_text")
