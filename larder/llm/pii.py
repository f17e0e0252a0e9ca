"""Operator 3: personal data by candidate gradient boosting, with DataFrame functions only.

Generators of high recall propose spans that may overlap: e-mail addresses, IPv4
addresses, payment cards, phone numbers with "+", and the further kinds of ``ADDED``
(national numbers, local phone numbers, IBANs, spelt-out addresses, names in fields, and
every long run of letters and digits as a possible secret). A span of the first four
kinds that passes its kind's own test (parts, digits, Luhn) is a base span and always stays.
Boosted trees of two levels score the further kinds by format and the characters around;
one threshold per kind, calibrated for precision on held-out values, selects which of them
are added, where they touch no base span. Of added spans that overlap the best scored stays.

Labels do not come from the features. A value is confirmed where a field name stands before it
somewhere ("token =", "tel."), where a local number ends a base phone number, or where
an IBAN passes its check sum. It is refuted where a word for something else stands before it
("order", "version", "commit"), where its check sum fails, or where it is not confirmed
anywhere but stands between different neighbours, ``COMMON`` or more and most times others, as
ordinary words do and copies do not. The trees see none of this,
so that they can find a bare key, and pass over a word that only looks like one.

Everything is computed inside the row: candidates are arrays, no text is shuffled and
a row's work depends on that row alone. Training folds all candidates by value (a hash;
partial aggregation first) and then into feature cells, counts by features, label and fold;
of these the ``CELLS`` largest at most, and nothing else, are fetched, and trees are fitted to them.

Cases: a null text is an empty one, without spans. Repeated rows give repeated
results, each row on its own. With no labels, or labels of one sort only, nothing
is added to the base spans; a kind with too few labels of its own has the threshold of all kinds
together. Runs of tens of thousands of letters or digits cost linear
time: patterns are possessive and start only where a run starts. Extra columns of any name stay in
find() and redact(); one named like the result ("spans") is overwritten. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import column, others, row, unpacked

PRECISION = 0.98
#: Held-out confirmed values that a kind's own threshold needs.
LEAST_HELD_OUT = 5
ROUNDS = 20
RATE = 0.3
#: Different neighbours that make an unconfirmed value an ordinary one.
COMMON = 3
#: The most feature cells that are fetched for fitting.
CELLS = 20_000

BASE = ("email", "ip", "card", "phone")
ADDED = ("national", "local", "iban", "spelt", "name", "secret")
#: What each generator looks for. The base kinds' patterns match what the plain patterns
#: do; "(?:\G|(?<!...))" and "++" only keep runs from being tried again from their middle,
#: and the card's look-arounds leave out runs that have not 16 to 19 digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local": r"(?<![0-9])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])",
    "spelt": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)++",
    "name": r"(?<=(?:[Nn]ame|[Cc]ontact|[Dd]ear|[Aa]ttn)[.:=]?\x20?)(?<![\p{L}])\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++){0,2}+",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+",
}
KINDS = tuple(PATTERNS)
#: A text without these holds no candidate of the kind.
NEEDS = {"email": ("@",), "phone": ("+",), "ip": (".",), "national": ("-",), "spelt": ("(at)", "[at]"), "name": ("ame", "ontact", "ear", "ttn")}

VALID = {
    "email": "true",
    "ip": "not exists(split(c.m, '[.]'), p -> length(ltrim('0', p)) > 3 or coalesce(try_cast(ltrim('0', p) as int), 0) > 255)",
    "card": "c.luhn",
    "phone": "length(regexp_replace(c.m, '[^0-9]', '')) between 8 and 15",
}
CONTEXT = 24
#: Words before a value that say what it is, or that it is something else.
FIELD = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|bearer|credentials?|ssn|social security|tax id|tel|telephone|phone|call|fax|mobile|iban|account|e-?mail|name|contact)(?: (?:is|no|nr|number))?[^a-z0-9]{0,6}$"
COUNTER = r"(?:order|invoice|version|release|isbn|sha-?[0-9]*|md5|commit|hash|checksum|build|model|part|sku|ref|page|date|doi|ticket|serial|https?://[^ ]*)(?: (?:is|no|nr|number))?[^a-z0-9]{0,6}$"
#: Features as small whole numbers, of c = (kind, start, end, m, before, after, luhn), and how many values each takes.
FEATURES = {
    "kind": "c.kind",
    "size": "case when length(c.m) < 12 then 0 when length(c.m) < 16 then 1 when length(c.m) < 20 then 2 when length(c.m) < 32 then 3 when length(c.m) < 48 then 4 else 5 end",
    "digits": "case when length(d) = 0 then 0 when length(d) = length(c.m) then 5 else 1 + cast(3.99 * length(d) / length(c.m) as int) end",
    "capitals": "case when not c.m rlike '[A-Z]' then 0 when not c.m rlike '[a-z]' then 3 when c.m rlike '^[A-Z][^A-Z]*$' then 1 else 2 end",
    "turns": "least(cast(ceil(size(regexp_extract_all(c.m, '[0-9]++(?=[A-Za-z])|[A-Za-z](?=[0-9])', 0)) / 2) as int), 5)",
    "marks": "least(length(regexp_replace(c.m, '[A-Za-z0-9]', '')), 4)",
    "prev": r"case when c.before = '' or c.before rlike '\\s$' then 0 when c.before rlike '[0-9]$' then 1 when c.before rlike '\\p{L}$' then 2 when c.before rlike '[=:]$' then 3 when c.before rlike '[\\x22\\x27(\\[]$' then 4 else 5 end",
    "next": r"case when c.after = '' or c.after rlike '^\\s' then 0 when c.after rlike '^[0-9]' then 1 when c.after rlike '^\\p{L}' then 2 when c.after rlike '^[.,;:!?]' then 3 when c.after rlike '^[\\x22\\x27)\\]]' then 4 else 5 end",
}
VALUES = {"kind": len(ADDED), "size": 6, "digits": 6, "capitals": 4, "turns": 6, "marks": 5, "prev": 6, "next": 6}

LUHN = """(aggregate(transform(sequence(1, greatest(length(d), 1)), i ->
    case when i % 2 = 1 then cast(substring(reverse(d), i, 1) as int)
         else 2 * cast(substring(reverse(d), i, 1) as int) - case when substring(reverse(d), i, 1) > '4' then 9 else 0 end end),
    0, (a, x) -> a + x) % 10 = 0)"""
#: The check sum of an IBAN: its letters as numbers, the first four characters last, modulo 97.
IBAN = """(aggregate(transform(split(concat(substring(replace(c.m, ' ', ''), 5), substring(replace(c.m, ' ', ''), 1, 4)), ''),
    x -> case when x = '' then -1 when x between '0' and '9' then ascii(x) - 48 else ascii(x) - 55 end),
    0, (a, x) -> case when x < 0 then a when x < 10 then (a * 10 + x) % 97 else (a * 100 + x) % 97 end) = 1)"""


def _candidates(df: DataFrame, text: str) -> DataFrame:
    """(row, _text, _was, _c): df's other columns, its text ("" for null) and as it was, all candidates as array<struct<kind, start, end, m, before, after, luhn>>, starts as code points from 0."""
    out = df.select(row(df, (text, "spans")), column(text).alias("_was")).withColumn("_text", F.coalesce("_was", F.lit("")))
    hits = {}
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
        if kind in NEEDS:
            some = F.lit(False)
            for part in NEEDS[kind]:
                some = some | F.contains("_text", F.lit(part))
            found = F.when(some, found).otherwise(F.array().cast("array<string>"))
        hits[f"_m_{kind}"] = found
    out = out.withColumns(hits)
    gaps = {f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.split("_text", p, -1)).otherwise(F.array().cast("array<string>")) for k, p in PATTERNS.items()}
    out = out.withColumns(gaps)
    starts = {
        f"_s_{k}": F.expr(
            f"aggregate(transform(_m_{k}, (x, i) -> struct(length(_g_{k}[i]) as gap, length(x) as len)),"
            " struct(0 as pos, cast(array() as array<int>) as out),"
            " (a, x) -> struct(a.pos + x.gap + x.len as pos, array_append(a.out, a.pos + x.gap) as out)).out"
        )
        for k in KINDS
    }
    out = out.withColumns(starts)
    luhn = LUHN.replace("(d)", "(regexp_replace(x, '[^0-9]', ''))")
    rows = [
        f"transform(_m_{k}, (x, i) -> struct({n} as kind, _s_{k}[i] as start, _s_{k}[i] + length(x) as end, x as m,"
        f" right(_g_{k}[i], {CONTEXT}) as before, left(_g_{k}[i + 1], {CONTEXT}) as after, {luhn if k == 'card' else 'false'} as luhn))"
        for n, k in enumerate(KINDS)
    ]
    return out.withColumn("_c", F.expr(f"concat({', '.join(rows)})")).drop(*[f"_{a}_{k}" for a in "mgs" for k in KINDS])


def _valid() -> str:
    return "case " + " ".join(f"when c.kind = {n} then {VALID[k]}" for n, k in enumerate(BASE)) + " else false end"


def _features() -> str:
    one = {k: v.replace("(d)", "(regexp_replace(c.m, '[^0-9]', ''))") for k, v in FEATURES.items()}
    return "struct(" + ", ".join(f"cast({v} as int) as {k}" for k, v in one.items()) + ")"


def values(df: DataFrame, text: str = "text") -> DataFrame:
    """(f, label, held) of each labelled value of df: its features (where it stands first), whether it is confirmed, its fold."""
    found = _candidates(df, text).withColumn("_base", F.expr(f"filter(_c, c -> {_valid()})"))
    kind = {k: n for n, k in enumerate(KINDS)}
    one = found.select(F.explode(F.filter("_c", lambda c: c["kind"] >= len(BASE))).alias("c"), "_base")
    in_phone = F.expr(f"c.kind = {kind['local']} and exists(_base, b -> b.kind = {kind['phone']} and b.start < c.start and c.end = b.end)")
    inside = F.expr("exists(_base, b -> b.start < c.end and c.start < b.end)")
    before = F.lower("c.before")
    iban = F.expr(f"case when c.kind = {kind['iban']} then {IBAN} end")
    told = one.select(
        F.xxhash64("c.kind", "c.m").alias("value"),
        F.xxhash64(F.right("c.before", F.lit(12)), F.left("c.after", F.lit(12))).alias("around"),
        F.expr(_features()).alias("f"),
        (in_phone | (before.rlike(FIELD) & ~inside) | F.coalesce(iban, F.lit(False))).alias("confirmed"),
        ((inside & ~in_phone) | before.rlike(COUNTER) | ~F.coalesce(iban, F.lit(True))).alias("refuted"),
    )
    kinds_of = [F.min("f").alias("f"), F.max("confirmed").alias("confirmed"), F.max("refuted").alias("refuted")]
    by_place = told.groupBy("value", "around").agg(*kinds_of, F.count("*").alias("n"))
    by_value = by_place.groupBy("value").agg(*kinds_of, F.sum("n").alias("n"), F.count("*").alias("places"))
    common = (F.col("places") >= COMMON) & (2 * F.col("places") > F.col("n"))
    label = F.when(F.col("confirmed") & ~F.col("refuted"), True).when(~F.col("confirmed") & (F.col("refuted") | common), False)
    return by_value.select("f", label.alias("label"), (F.pmod("value", F.lit(2)) == 1).alias("held")).where("label is not null")


def cells(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts of values() by features, label and fold."""
    return values(df, text).groupBy("f", "label", "held").agg(F.count("*").alias("n")).select("f.*", "label", "held", "n")


class Model:
    """Boosted two-level trees [(feature, cut, (feature, cut, low, high), (feature, cut, low, high))], a start, a threshold per kind."""

    def __init__(self, start: float, trees: list, thresholds: dict[int, float]):
        self.start, self.trees, self.thresholds = start, trees, thresholds

    def score(self, x: dict) -> np.ndarray:
        """The scores of rows whose features are arrays."""
        total = np.full(len(x["kind"]), self.start)
        for f, cut, low, high in self.trees:
            low, high = (np.where(x[g] <= c, a, b) for g, c, a, b in (low, high))
            total += np.where(x[f] <= cut, low, high)
        return total

    def sql(self) -> str:
        def leaf(t):
            return f"case when f.{t[0]} <= {t[1]} then {t[2]!r}D else {t[3]!r}D end"

        return " + ".join([f"{self.start!r}D", *(f"case when f.{f} <= {c} then {leaf(a)} else {leaf(b)} end" for f, c, a, b in self.trees)])

    def kinds(self) -> list[int]:
        return sorted(k for k, t in self.thresholds.items() if t < math.inf)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _best_cut(x: dict, grad: np.ndarray, curve: np.ndarray, cuts: list) -> tuple:
    """The (feature, cut, low, high) that gains most."""
    best = None
    for f, cut in cuts:
        up = x[f] > cut
        g, h = (grad[~up].sum(), grad[up].sum()), (1 + curve[~up].sum(), 1 + curve[up].sum())
        gain = g[0] ** 2 / h[0] + g[1] ** 2 / h[1]
        if best is None or gain > best[0] + 1e-12:
            best = (gain, (f, cut, float(RATE * g[0] / h[0]), float(RATE * g[1] / h[1])))
    return best[1]


def _threshold(scores: np.ndarray, label: np.ndarray, n: np.ndarray, precision: float) -> float:
    """The lowest score from which on held-out values are right to that precision; infinite without LEAST_HELD_OUT confirmed ones."""
    order = np.argsort(-scores, kind="stable")
    scores, right, total = scores[order], np.cumsum((n * label)[order]), np.cumsum(n[order])
    if not len(scores) or right[-1] < LEAST_HELD_OUT:
        return math.inf
    last = np.append(scores[1:] < scores[:-1], True)
    fine = np.flatnonzero(last & (right >= LEAST_HELD_OUT) & (right >= precision * total))
    return float(scores[fine[-1]]) if len(fine) else math.inf


def fit(rows: list, precision: float = PRECISION) -> Model:
    """A model from the fetched cells."""
    rows = sorted(rows, key=lambda r: tuple(r[f] for f in FEATURES) + (r["label"], r["held"]))
    x = {f: np.array([r[f] for r in rows], np.int64) for f in FEATURES}
    label, held, n = (np.array([r[c] for r in rows], t) for c, t in (("label", bool), ("held", bool), ("n", np.float64)))
    own = {f: v[~held] for f, v in x.items()}
    y, weight = label[~held].astype(np.float64), n[~held]
    good, bad = (weight * y).sum(), (weight * (1 - y)).sum()
    if not good or not bad:
        return Model(0.0, [], {})
    model = Model(float(np.log(good / bad)), [], {})
    cuts = [(f, int(c)) for f in FEATURES for c in np.unique(own[f])[:-1]]
    for _ in range(ROUNDS if cuts else 0):
        p = _sigmoid(model.score(own))
        grad, curve = weight * (y - p), weight * p * (1 - p)
        f, cut, _, _ = _best_cut(own, grad, curve, cuts)
        up = own[f] > cut
        low, high = (_best_cut({k: v[side] for k, v in own.items()}, grad[side], curve[side], cuts) for side in (~up, up))
        model.trees.append((f, cut, low, high))
    scores = model.score(x)
    every = _threshold(scores[held], label[held], n[held], precision)
    for kind in range(len(BASE), len(KINDS)):
        of_kind = held & (x["kind"] == kind)
        mine = _threshold(scores[of_kind], label[of_kind], n[of_kind], precision)
        few = (n * label)[of_kind].sum() < LEAST_HELD_OUT
        model.thresholds[kind] = every if few else mine
    return model


def train(df: DataFrame, text: str = "text") -> Model:
    return fit(cells(df, text).orderBy(F.desc("n"), *FEATURES, "label", "held").limit(CELLS).collect())


def _found(df: DataFrame, model: Model, text: str) -> DataFrame:
    """_candidates() with spans array<struct<kind, start, end>>, ordered by kind (0 to 3: base), then start."""
    out = _candidates(df, text).withColumn("_base", F.expr(f"filter(_c, c -> {_valid()})"))
    if not model.kinds():
        added = F.filter("_c", lambda c: F.lit(False))
    else:
        free = f"filter(_c, c -> c.kind in ({', '.join(map(str, model.kinds()))}) and not exists(_base, b -> b.start < c.end and c.start < b.end))"
        scored = f"transform(transform({free}, c -> struct(c as c, {_features()} as f)), x -> struct(x.c as c, aggregate(array(x.f), 0D, (a, f) -> {model.sql()}) as score))"
        least = "case " + " ".join(f"when x.c.kind = {k} then {model.thresholds[k]!r}D" for k in model.kinds()) + " end"
        out = out.withColumn("_s", F.expr(f"filter({scored}, x -> x.score >= {least})"))
        better = "y.c.start < x.c.end and x.c.start < y.c.end and (y.score > x.score or y.score = x.score and (y.c.kind < x.c.kind or y.c.kind = x.c.kind and y.c.start < x.c.start))"
        added = F.expr(f"transform(filter(_s, x -> not exists(_s, y -> {better})), x -> x.c)")
    spans = F.transform(F.concat("_base", added), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return out.withColumn("spans", F.array_sort(spans)).select("row", "_text", "_was", "spans")


def find(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with spans array<struct<kind, start, end>>, ordered by kind (0 to 3: base), then start."""
    kept = others(df, (text, "spans"))
    rows = {c: r for c, r in zip(kept, unpacked(kept))} | {text: F.col("_was").alias(text)}
    return _found(df, model, text).select(*[rows[c] for c in df.columns if c in rows], "spans")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with every span in the text replaced by its kind in brackets; spans that touch or overlap become one, named by the first."""
    found = _found(df, model, text).withColumn("_o", F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    merged = F.expr(
        "aggregate(_o, cast(array() as array<struct<start:int,end:int,kind:int>>), (a, s) ->"
        " case when size(a) > 0 and element_at(a, -1).end > s.start"
        " then concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end), 'kind', element_at(a, -1).kind)))"
        " else concat(a, array(s)) end)"
    )
    names = "array(" + ", ".join(f"'[{k}]'" for k in KINDS) + ")"
    parts = F.expr(
        f"concat(transform(_u, (s, i) -> concat(substring(_text, case when i = 0 then 1 else _u[i - 1].end + 1 end, s.start - case when i = 0 then 0 else _u[i - 1].end end), {names}[s.kind])),"
        " array(substring(_text, element_at(_u, -1).end + 1)))"
    )
    out = found.withColumn("_u", merged)
    changed = F.when(F.size("_u") > 0, F.array_join(parts, "")).otherwise(F.col("_was"))
    kept = others(df, (text, "spans"))
    rows = {c: r for c, r in zip(kept, unpacked(kept))} | {text: changed.alias(text)}
    return out.select(*[rows[c] for c in df.columns if c in rows])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, train(docs))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    of_kind = lambda n: F.filter("spans", lambda s: s["kind"] == n)
    counts = [F.size(of_kind(n)).cast("long").alias(f"n_{k}") for n, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


QUERIES = {"op3_pii": op3_pii}
