"""The registered queries of the corpus operators on the smallest tables, against libraries, SQL and plain code."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import registry

DATA = "/root/testdata/sf0.001"
QUERIES = registry.queries()
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    return QUERIES[name](spark, DATA).collect()


def test_all_thirteen_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_op1_equals_the_library(spark, texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    t.no_truncation(), t.no_padding()
    ids = {k: t.encode(x, add_special_tokens=False).ids for k, x in texts.items()}
    want = {k: (len(i), sha(",".join(map(str, i))), sha(t.decode(i, skip_special_tokens=False))) for k, i in ids.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, "op1_bpe")} == want


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_spans(text):
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for kind, pattern, fine in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9](?:[ -]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if fine(m[0])]
    return out


def test_op3_base_spans(spark, texts):
    for r in rows(spark, "op3_pii"):
        spans = base_spans(texts[r.doc_id])
        count = lambda kind: sum(k == kind for k, _, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(count, ("email", "ip", "card", "phone")))
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(","))


def test_op5_equals_its_sql(spark):
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{DATA}/pages.parquet'")
    said = db.execute(registry.oracle_sql()["op5_urls"])
    names = [d[0] for d in said.description]
    assert sorted(map(repr, said.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in rows(spark, "op5_urls"))


def test_op7_on_documents_held_out(spark):
    told = {r.doc_id: r for r in rows(spark, "op7_language")}
    given = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2).alias("out")).collect()
    assert all(told[r.doc_id].held_out == r.out and 0 <= told[r.doc_id].score <= 1 for r in given)
    unseen = [told[r.doc_id].lang_pred == r.lang for r in given if r.out and r.lang and re.search(r"[^\W\d_]", r.text or "")]
    assert len(unseen) > 20 and np.mean(unseen) >= 0.95
    assert all(told[r.doc_id].lang_pred == "und" for r in given if not re.search(r"[^\W\d_]", r.text or ""))


def test_op8_recall(spark):
    given = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    v = np.array([r.embedding for r in given], np.float64)
    ids = np.array([r.vec_id for r in given])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = {}
    for r in rows(spark, "op8_neighbours"):
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = u @ u[ids == q][0]
        s[ids == q] = -2
        best = ids[np.lexsort((ids, -np.round(s, 12)))[:5]]
        hits, total = hits + len(set(best) & set(found[q])), total + len(best)
    assert total and hits / total >= 0.9


def test_op10_digests(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = {-1: [("user", said), ("assistant", said)]}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    want = {}
    for c, t in turns.items():
        loss = "".join(x for role, x in t if role == "assistant")
        want[c] = (len(t), sha("".join(f"{role}\n{x}\n" for role, x in t)), len(loss), sha(loss))
    got = rows(spark, "op10_chat")
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    assert all(r.formatted_chars > r.loss_chars for r in got)
