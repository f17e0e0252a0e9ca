"""Operator 13: fill-in-middle transformation of whole texts, and its exact inverse.

A text is cut into lines (units). Two cuts between units, drawn by a hash of the document's
id, make prefix, middle and suffix. The segments are exchanged in place: cuts are found by
a scan of the text's bytes, sentinels are inserted in one bytearray, and two neighbouring segments
change places by a rotation of three reversals (each one, then both). ``psm`` takes one rotation
(middle with suffix), ``spm`` a second one (prefix with suffix). restore() finds the sentinels
again, rotates back and deletes them.

Every row is worked on where it was read: no shuffle, and a lost executor costs its
splits only. Memory is one slice of a batch, some five times its longest text.

Cases: a null text is an empty one; empty texts and texts that hold a sentinel stay ``plain``.
A null id draws like an empty one. Repeated rows give equal results. All bytes that are not line
feeds belong to a line, so texts of any length and without a line feed are one unit. All columns stay, but for
those that are called like new ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .columns import column, others, row

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
FORMS = ("plain", "psm", "spm")
NEW = "units long, form string, prefix_chars long, middle_chars long, infill string, restored string"


def draws(seed: int, key) -> list[int]:
    """Four unsigned numbers of 32 bits for a document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def unit_ends(text: bytes) -> np.ndarray:
    """Where each line ends, the line feed included; the last line need not have one."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if not text or text.endswith(b"\n") else np.append(ends, len(text))


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Segments start:cut and cut:end change places: each is reversed, then both together."""
    for a, b in ((start, cut), (cut, end), (start, end)):
        buffer[a:b] = buffer[a:b][::-1]


def chars(part) -> int:
    """Code points of UTF-8 bytes: all but continuation bytes begin one."""
    return len(part) - int(np.count_nonzero(np.frombuffer(part, np.uint8) & 0xC0 == 0x80))


def transform(text: bytes, key, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, prefix_chars, middle_chars, output) of one text."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    at = [0, *ends.tolist()]
    low, high = sorted((at[h1 % (n + 1)], at[h2 % (n + 1)]))
    counts = chars(text[:low]), chars(text[low:high])
    buffer = bytearray(text)
    buffer[high:high] = SUFFIX
    buffer[low:low] = MIDDLE
    buffer[0:0] = PREFIX
    size, middle = len(buffer), low + len(PREFIX)
    suffix = high + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle, suffix, size)
    if h4 % 100 >= spm_rate:
        return n, "psm", *counts, bytes(buffer)
    rotate(buffer, 0, middle, middle + size - suffix)
    return n, "spm", *counts, bytes(buffer)


def restore(output: bytes, form: str) -> bytes:
    """The text that transform() made output of."""
    if form == "plain":
        return output
    if form not in FORMS:
        raise ValueError(f"unknown form {form}")
    buffer, size = bytearray(output), len(output)
    end = buffer.index(MIDDLE)
    if form == "spm":
        rotate(buffer, 0, buffer.index(PREFIX), end)
    start = buffer.index(SUFFIX)
    rotate(buffer, start, end, size)
    # now prefix, middle, suffix, each behind its sentinel
    high = start + size - end
    del buffer[high : high + len(SUFFIX)]
    del buffer[start : start + len(MIDDLE)]
    del buffer[0 : len(PREFIX)]
    return bytes(buffer)


def _binary(values: pa.Array) -> list[bytes]:
    return [x or b"" for x in values.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def infill(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, keep_text: bool = True) -> DataFrame:
    """df with units, form, prefix_chars, middle_chars, infill (the output) and restored (rebuilt from it)."""
    names = [c.split()[0] for c in NEW.split(", ")]
    kept = others(df, names + ([] if keep_text else [text]))
    again = text in kept
    rows = df.select(row(df, [*names, text]), column(text).cast("string").alias("text"), column(key).cast("string").alias("key"))
    plain = [rows.schema["row"], *([rows.schema["text"]] if again else [])]

    def run(batches):
        for batch in batches:
            for part in slices([batch], 1):
                done = [transform(t, k, seed, rate, spm_rate) for t, k in zip(_binary(part.column(1)), part.column(2).to_pylist())]
                units, forms, before, within, out = zip(*done)
                texts = [pa.array(x, pa.binary()).cast(pa.string(), safe=False) for x in (out, [restore(o, f) for o, f in zip(out, forms)])]
                arrays = [pa.array(units, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(within, pa.int64()), *texts]
                yield pa.RecordBatch.from_arrays([part.column(0), *([part.column(1)] if again else []), *arrays], [*[f.name for f in plain], *names])

    schema = df.sparkSession.createDataFrame([], NEW).schema
    done = rows.mapInArrow(run, type(schema)([*plain, *schema.fields]))
    return done.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in kept], *map(column, names))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return infill(docs, keep_text=False).select(
        "doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("infill", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


#: Texts, pieces and digests in DuckDB's own functions: lines by regular expression, no bytes.
ORACLE_SQL = {
    "op13_infill": """
        with given as (
            select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as h,
                regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as lines
            from documents),
        drawn as (
            select *, len(lines)::bigint as n, ('0x' || h[1:8])::bigint % (len(lines) + 1) as c1, ('0x' || h[9:16])::bigint % (len(lines) + 1) as c2,
                case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 100 then 'plain'
                    when ('0x' || h[25:32])::bigint % 100 < 50 then 'spm' else 'psm' end as form
            from given),
        parts as (
            select *, array_to_string(lines[1:least(c1, c2)], '') as p, array_to_string(lines[least(c1, c2) + 1:greatest(c1, c2)], '') as m,
                array_to_string(lines[greatest(c1, c2) + 1:], '') as s
            from drawn)
        select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
            sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
            sha256(text) as restored_sha256
        from parts"""
}
QUERIES = {"op13_infill": op13_infill}
