"""Personal data by weak supervision, in DataFrame functions only.

Four base kinds come from fixed patterns and checks.  A fifth kind, ``secret``
(keys, tokens, passwords), has no single reliable pattern: candidate spans are
opaque strings, and labelers vote on each - a *regex* labeler (known shapes),
a *gazetteer* labeler (the word before it) and *context* labelers (assignment
or quote before it, mixture of letters and digits, length).  Votes and coarse
features are counted by pattern, so what reaches the driver is a table bounded by the
number of patterns, not by the data.  Expectation-maximisation over these
counts estimates how reliable each labeler is and the chance that each vote
pattern is right; a logistic span classifier is trained on those soft labels
and applied as a column expression.

Offsets are code points.  A pattern's matches and the gaps between them come
from ``regexp_extract_all`` and ``split``; running lengths give the offsets.
Patterns are written so that Java's matcher is linear on very long texts: runs
are possessive and may start only where a run starts or where the last match
ended, which finds the same leftmost matches.

Null texts are empty; rows are independent, so repeated rows and null ids are
kept; extra columns are ignored; an empty table gives no rows, and without any
candidate nothing beyond the base spans is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import read

# The base patterns, in linear-time form.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
BASE = ("email", "ip", "card", "phone")
# Candidates of the added kind, its shapes and the words that announce it.
CANDIDATE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{12,}+"
SHAPES = r"^(AKIA[0-9A-Z]{16}|(?=[0-9]*[a-f])[0-9a-f]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9-]{16,}|xox[abp]-[A-Za-z0-9-]{10,})$"
WORDS = ("password", "passwd", "pwd", "passphrase", "token", "secret", "key", "apikey", "api_key", "access_key", "credential", "auth", "bearer")
LABELERS = ("shape", "word", "assigned", "mixed", "length")
FEATURES = ("shape", "word", "assigned", "quoted", "hex", "upper", "digits", "long")
CHUNK = 128


def _spans(text: Column, pattern: str) -> Column:
    """Array of (s, e, m, before) of all matches, offsets in code points."""
    pat = F.lit(pattern)
    found = F.regexp_extract_all(text, pat, F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("g"), found.alias("m"))
    row = "struct<s:int,e:int,m:string,before:string>"

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        one = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), F.right(x["g"], F.lit(32)).alias("before"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def chunk(acc: Column, k: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast(f"array<{row}>").alias("out"))
        part = F.aggregate(F.slice(acc["all"], k * CHUNK + 1, F.lit(CHUNK)), start, step)
        return F.struct(part["at"].alias("at"), acc["all"].alias("all"), F.concat(acc["out"], F.array(part["out"])).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), pairs.alias("all"), F.array().cast(f"array<array<{row}>>").alias("out"))
    chunks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int"))
    folded = F.aggregate(chunks, begin, chunk, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(found) > 0, folded).otherwise(F.array().cast(f"array<{row}>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Check sum of up to 19 digits: from the right, every second digit doubled."""
    chars = F.split(F.reverse(digits), "")
    value = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v) % 10 == 0


PRIVATE = {"_text", "_candidate", "_secret", *(f"_{k}" for k in BASE)}  # columns that the steps below add


def with_spans(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All input columns, ``_text`` (null as empty) and the span arrays email, ip, card, phone, candidate as ``_<kind>``.

    Other input columns with one of these names are replaced.
    """
    t = F.col("_text")
    d = docs.drop(*[c for c in docs.columns if c.lower() in PRIVATE and c != text_column])
    d = d.withColumn("_text", F.coalesce(F.col(text_column), F.lit("")))
    none = F.array().cast("array<struct<s:int,e:int,m:string,before:string>>")

    def gate(needs: Column, pattern: str) -> Column:
        return F.when(needs, _spans(t, pattern)).otherwise(none)

    d = d.select("*", gate(F.contains(t, F.lit("@")), EMAIL).alias("_email"), gate(t.rlike(r"[0-9]\.[0-9]"), IP).alias("_ip"),
                 gate(t.rlike(r"[0-9][\x20-]?[0-9]"), CARD).alias("_card"), gate(t.rlike(r"\+[0-9]"), PHONE).alias("_phone"),
                 gate(t.rlike("[0-9]"), CANDIDATE).alias("_candidate"))
    keep_card = lambda x: F.when(F.length(_digits(x["m"])).between(16, 19), _luhn(_digits(x["m"]))).otherwise(F.lit(False))
    return (d.withColumn("_ip", F.filter("_ip", lambda x: x["m"].rlike(OCTETS)))
            .withColumn("_card", F.filter("_card", keep_card))
            .withColumn("_phone", F.filter("_phone", lambda x: F.length(_digits(x["m"])).between(8, 15))))


def _evidence(x: Column) -> dict[str, Column]:
    """Yes/no features of a candidate."""
    m, before = x["m"], F.lower(x["before"])
    word = F.regexp_extract(before, r"([a-z_]+)[\s=:\"'>(]*$", 1)
    hexes = F.length(F.regexp_replace(m, "[0-9a-f]", "")) == 0
    share = F.length(_digits(m)) / F.length(m)
    return {
        "shape": m.rlike(SHAPES), "word": word.isin(*WORDS), "assigned": before.rlike(r"[=:]\s*[\"']?$"),
        "quoted": before.rlike("[\"']$"), "hex": hexes, "upper": m.rlike("[A-Z]"), "digits": share.between(0.15, 0.85),
        "long": F.length(m) >= 16, "mixed": share.between(0.2, 0.8) & m.rlike("[A-Za-z]"), "length": F.length(m) >= 16,
    }


def count_patterns(spans: DataFrame) -> list[tuple[tuple[int, ...], tuple[int, ...], int]]:
    """(votes, features, count) of all candidates: at most 2**10 patterns whatever the data."""
    c = spans.select(F.explode("_candidate").alias("c"))
    e = _evidence(F.col("c"))
    names = sorted(e)
    c = c.select(*[F.coalesce(e[n].cast("int"), F.lit(0)).alias(n) for n in names]).groupBy(*names).count()
    return [(tuple(r[n] for n in LABELERS), tuple(r[n] for n in FEATURES), r["count"]) for r in c.collect()]


def reliabilities(patterns: list, rounds: int = 50) -> tuple[list[tuple[float, float]], float, dict]:
    """EM over vote patterns: per labeler (yes if true, yes if false), prior, and chance of truth by votes."""
    rates = [(0.8, 0.2)] * len(LABELERS)
    prior, post = 0.5, {}
    total = sum(n for _, _, n in patterns)
    for _ in range(rounds if total else 0):
        post = {}
        for votes, _, _ in patterns:
            yes, no = math.log(prior), math.log(1 - prior)
            for v, (a, b) in zip(votes, rates):
                yes, no = yes + math.log(a if v else 1 - a), no + math.log(b if v else 1 - b)
            post[votes] = 1 / (1 + math.exp(min(60, no - yes)))
        true = sum(post[v] * n for v, _, n in patterns)
        prior = min(0.99, max(0.01, (true + 1) / (total + 2)))
        rates = [((sum(post[v] * n for v, _, n in patterns if v[k]) + 1.6) / (true + 2),
                  (sum((1 - post[v]) * n for v, _, n in patterns if v[k]) + 0.4) / (total - true + 2)) for k in range(len(LABELERS))]
        rates = [(min(0.99, max(0.01, a)), min(0.99, max(0.01, b))) for a, b in rates]
    return rates, prior, post


def train(patterns: list, steps: int = 400) -> list[float]:
    """Weights (bias last) of the span classifier, fitted to the soft labels of the EM step."""
    _, _, post = reliabilities(patterns)
    w = [0.0] * (len(FEATURES) + 1)
    total = sum(n for _, _, n in patterns)
    if not total:
        return [0.0] * len(FEATURES) + [-1.0]
    for _ in range(steps):
        g = [1e-3 * x for x in w[:-1]] + [0.0]
        for votes, feats, n in patterns:
            z = w[-1] + sum(x for x, f in zip(w, feats) if f)
            d = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - post[votes]) * n / total
            for k, f in enumerate(feats):
                g[k] += d * f
            g[-1] += d
        w = [x - 2.0 * y for x, y in zip(w, g)]
    return w


def find_pii(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Input columns and ``_email _ip _card _phone _secret``: arrays of (s, e, m, before)."""
    spans = with_spans(docs, text_column)
    w = train(count_patterns(spans.select("_candidate")))

    def chosen(x: Column) -> Column:
        e = _evidence(x)
        score = F.lit(w[-1])
        for name, weight in zip(FEATURES, w):
            score = score + F.when(e[name], F.lit(weight)).otherwise(F.lit(0.0))
        return score >= 0
    return spans.withColumn("_secret", F.filter("_candidate", chosen)).drop("_candidate")


def _listed(kinds: tuple[str, ...]) -> Column:
    def one(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))
    return F.array_join(F.concat(*map(one, kinds)), ",")


def describe(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts, digest of the base spans and all spans as text."""
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(F.col(id_column), *counts, F.sha2(_listed(BASE).cast("binary"), 256).alias("base_sha256"),
                        _listed((*BASE, "secret")).alias("spans"), F.size("_secret").cast("long").alias("n_secret"))


def redact(found: DataFrame, text_column: str = "text") -> Column:
    """The text with every span replaced by ``<KIND>``; overlapping spans take the first one's mark."""
    def tagged(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"<{kind.upper()}>").alias("mark")))

    spans = F.array_sort(F.concat(*map(tagged, (*BASE, "secret"))))
    text = F.col("_text")

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        new = F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.array(gap, x["mark"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), new.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, rest)).otherwise(F.col(text_column))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(find_pii(read(spark, sf_dir, "documents").select("doc_id", "text")))
