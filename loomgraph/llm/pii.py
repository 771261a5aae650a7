"""Personal data: patterns propose candidate spans, boosted trees score them, calibrated thresholds choose.

Candidates are found and described by DataFrame functions. The trees are fitted to all candidates of all documents at
hand, counted by their features, and to some made-up spans in context, and become an SQL expression. Of the documents' candidates those that meet a span of a base kind are personal data; what shows that (a plus,
an at sign) is not among the features. Those without any cue of personal data, or with a cue of something else, are none;
the others teach nothing. Thresholds are calibrated on candidates of other documents. The contract's base kinds are kept
whatever their score.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .boosting import binned, fitted, threshold
from .common import Workspace, documents, text_or_empty

BASE = ("email", "ip", "card", "phone")
#: Generators beyond the base kinds; what they propose may overlap. Fixed values.
GENERATORS = [
    # As are the base patterns, repeated parts are one character wide: the JVM matches wider ones by recursion, which
    # a long text would overflow. A separator counts if digits stand around it and at most one other.
    ("number", r"(?<![A-Za-z0-9])[(]?[0-9](?:[0-9\x20().-](?<=[0-9]|[0-9][\x20().-](?=[\x20().-]?[0-9])|[0-9][\x20().-][\x20().-](?=[0-9]))){6,}+(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("contact", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]+){1,8}"),
]
#: Which texts are worth trying a generator on: one fast pass.
HINTS = {"number": None, "iban": r"[A-Z]{2}[0-9]{2}", "contact": r"[(\[\x20]at[)\]\x20]"}
#: Characters of context before and after a candidate that its features look at.
CONTEXT = 24
#: Made-up spans that the trees are fitted to and calibrated on besides the documents'.
TRAIN_SPANS = 1_200
#: Scores that calibration tells apart.
SCORES = 10_000
#: One in so many documents and made-up spans is kept for calibration.
HELD = 3
PRECISION = 0.97
FEATURES = ("length", "digits", "separators", "groups", "longest", "parens", "dots", "dashes", "luhn", "letters", "marked", "cue_phone", "cue_id", "cue_bank", "cue_not", "kind_iban", "kind_contact", "year")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of the text have a Luhn check sum of zero."""
    d = F.reverse(digits(text))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(d), F.lit(1))), lambda i: F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise((F.substr(d, i, F.lit(1)).cast("int") * 2 - F.when(F.substr(d, i, F.lit(1)) > "4", 9).otherwise(0))))
    return (F.char_length(d) > 0) & (F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0)


def _email(text: Column) -> Column:
    # A match begins where its run of name characters does, or where the last match ended inside one.
    # A dot belongs to the domain if it stands between its other characters.
    pattern = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])(?:[A-Za-z0-9.-](?<=[A-Za-z0-9-]|[A-Za-z0-9-]\.(?=[A-Za-z0-9-])))++"
    return F.when(F.contains(text, F.lit("@")), spans.find(text, pattern)).otherwise(F.array().cast(spans.SPAN))


def _ip(text: Column) -> Column:
    pattern = r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"

    def small(m: Column) -> Column:
        return F.forall(F.split(m, "\\."), lambda x: (F.char_length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(x, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))

    return spans.find(text, pattern, small)


def _card(text: Column) -> Column:
    # A separator belongs to the run if it stands between digits. Runs of fewer than 12 characters can't be cards.
    pattern = r"[0-9](?:[0-9\x20-](?<=[0-9]|[0-9][\x20-](?=[0-9]))){11,}+"
    return spans.find(text, pattern, lambda m: F.when(F.char_length(digits(m)).between(12, 19), luhn(m)).otherwise(False))


def _phone(text: Column) -> Column:
    pattern = r"\+[0-9][\x20().0-9-]+[0-9]"
    found = spans.find(text, pattern, lambda m: F.char_length(digits(m)).between(9, 15))
    return F.when(F.contains(text, F.lit("+")), found).otherwise(F.array().cast(spans.SPAN))


def base_spans(text: Column) -> Column:
    """The contract's spans, tagged, unsorted."""
    return F.concat(*(spans.tagged(f(text), k, i) for i, (k, f) in enumerate(zip(BASE, (_email, _ip, _card, _phone)))))


def proposals(text: Column) -> Column:
    """Candidate spans of all generators; spans of different generators may overlap."""
    each = []
    for i, (kind, pattern) in enumerate(GENERATORS):
        own = spans.tagged(spans.find(text, pattern), kind, len(BASE) + i)
        each.append(F.when(F.rlike(text, F.lit(HINTS[kind])), own).otherwise(F.array().cast(spans.TAGGED)) if HINTS[kind] else own)
    return F.concat(*each)


def _count(value: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(value, pattern, ""))


def described(text: Column, found: Column) -> Column:
    """Candidates with their features: format of the value, and cues in the text around it."""

    def one(s: Column) -> Column:
        v = s["value"]
        before = F.lower(F.substr(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT))))
        runs = F.split(F.btrim(F.regexp_replace(v, "[^0-9]+", " ")), " ")
        values = {
            "length": F.char_length(v), "digits": F.char_length(digits(v)), "separators": _count(v, "[A-Za-z0-9]"), "groups": F.size(runs),
            "longest": F.array_max(F.transform(runs, lambda r: F.char_length(r))), "parens": _count(v, "[^()]"), "dots": _count(v, "[^.]"), "dashes": _count(v, "[^-]"),
            "luhn": luhn(v).cast("int"), "letters": _count(v, "[^A-Za-z]"), "marked": F.rlike(before, F.lit(r"[#$%:=\"']\s?$")).cast("int"),
            "cue_phone": F.rlike(before, F.lit(r"(phone|tel|call|mobile|cell|fax|telefon|appel)")).cast("int"), "cue_id": F.rlike(before, F.lit(r"(ssn|social|passport|licen[cs]e|tax id|national)")).cast("int"),
            "cue_bank": F.rlike(before, F.lit(r"(iban|account|konto|bank)")).cast("int"), "cue_not": F.rlike(before, F.lit(r"(isbn|order|version|invoice|ref|serial|page|date|part|tracking|build|price|total)")).cast("int"),
            "kind_iban": (s["kind"] == "iban").cast("int"), "kind_contact": (s["kind"] == "contact").cast("int"), "year": F.rlike(v, F.lit(r"(^|[^0-9])(19|20)[0-9]{2}([^0-9]|$)")).cast("int"),
        }
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), v.alias("value"), *(F.coalesce(values[k].cast("double"), F.lit(0.0)).alias(k) for k in FEATURES))

    return F.transform(found, one)


def made_up(n: int, seed: int) -> list[tuple[str, int]]:
    """Texts with one span each, and whether it is personal data."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice(("an", "er", "tion", "the", "sch", "ou", "que", "mi", "st", "ver")) for _ in range(r.randint(1, 4)))
    cap = lambda k: "".join(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(k))
    yes = [
        lambda: (r.choice(("phone ", "tel. ", "call ", "mobile: ", "fax ", "")), f"({d(3)}) {d(3)}-{d(4)}"),
        lambda: (r.choice(("phone ", "tel. ", "call me at ", "cell ")), f"{d(3)}{(s := r.choice('-. '))}{d(3)}{s}{d(4)}"),
        lambda: (r.choice(("SSN ", "social security ", "ssn: ", "")), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (r.choice(("Telefon ", "tel ", "appel ")), f"0{d(3)} {d(7)}"),
        lambda: (r.choice(("IBAN ", "account ", "Konto ", "")), f"{cap(2)}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"),
        lambda: (r.choice(("IBAN: ", "bank ", "")), f"{cap(2)}{d(2)}{d(18)}"),
        lambda: (r.choice(("mail ", "write to ", "")), f"{w()}.{w()}{r.choice((' at ', '(at)', ' [at] '))}{w()}{r.choice((' dot ', '(dot)', '.'))}com"),
    ]
    no = [
        lambda: (r.choice(("order ", "invoice ", "ref ", "serial ", "tracking ", "")), d(r.randint(7, 18))),
        lambda: (r.choice(("date ", "on ", "")), f"{r.choice((19, 20))}{d(2)}-{d(2)}-{d(2)}"),
        lambda: (r.choice(("on ", "", "date ")), f"{d(2)}.{d(2)}.{r.choice((19, 20))}{d(2)}"),
        lambda: (r.choice(("ISBN ", "isbn ")), f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}"),
        lambda: (r.choice(("version ", "build ", "")), f"{d(1)}.{d(2)}.{d(3)}.{d(4)}"),
        lambda: (r.choice(("price ", "total ", "$", "")), f"{d(3)}.{d(3)}.{d(3)}"),
        lambda: (r.choice(("page ", "", "part ")), f"{d(1)}.{d(9)}"),
        lambda: ("", f"{r.choice((19, 20))}{d(2)}-{r.choice((19, 20))}{d(2)}"),
        lambda: (r.choice(("part ", "serial ", "")), f"{cap(2)}{d(2)}{cap(4)}{d(1)}{cap(3)}"),
        lambda: (r.choice(("meet ", "look ", "")), f"{w()} at {w()}. {w().title()}"),
    ]
    out = []
    for i in range(n):
        cue, value = r.choice(yes if i % 2 else no)()
        out.append((f"{w()} {w()} {cue}{value} {w()} {w()}", i % 2))
    return out


def labelled(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): (doc_id, y, x) of every candidate whose label is known, of all documents."""
    text = F.col("text")
    rows = docs.select("doc_id", "text").filter("text is not null").withColumn("base", base_spans(text)).withColumn("found", proposals(text)).filter(F.size("found") > 0)
    rows = rows.select("doc_id", "base", F.explode(described(text, F.col("found"))).alias("x"))
    met = F.exists("base", lambda b: _meets(b, F.col("x")))
    cue = (F.col("x.cue_phone") + F.col("x.cue_id") + F.col("x.cue_bank")) > 0
    other = (F.col("x.cue_not") > 0) | (F.col("x.year") > 0) | ~cue
    y = F.when(met, 1.0).when(other, 0.0)
    return rows.select("doc_id", y.alias("y"), "x").filter("y is not null")


@dataclass
class Model:
    """sql: the score of a struct x; cuts: each kind's threshold; precision and recall of the documents' held-out candidates."""

    sql: str
    cuts: tuple[tuple[str, float], ...]
    precision: float
    recall: float


def examples(spark: SparkSession, docs: DataFrame, seed: int = 5) -> DataFrame:
    """(kind, features, y, real, held, n): the labelled candidates of all documents and the made-up ones, counted by what the trees see of them."""
    values = ", ".join(f"({i}, '{t}', {y}D)" for i, (t, y) in enumerate(made_up(TRAIN_SPANS, seed)))
    made = spark.sql(f"SELECT * FROM VALUES {values} AS t(id, text, y)")
    made = made.select(F.col("id").cast("long").alias("id"), "y", F.explode(described(F.col("text"), proposals(F.col("text")))).alias("x"), F.lit(0).alias("real"))
    real = labelled(docs).select(F.xxhash64("doc_id").alias("id"), "y", "x", F.lit(1).alias("real"))
    seen = [binned(F.col(f"x.{k}")).alias(k) for k in FEATURES]
    both = made.union(real).select("x.kind", *seen, "y", "real", (F.pmod("id", F.lit(HELD)) == 0).alias("held"))
    return both.groupBy("kind", *FEATURES, "y", "real", "held").agg(F.count("*").alias("n"))


def model(spark: SparkSession, docs: DataFrame, seed: int = 5) -> Model:
    rows = Workspace(spark, "pii").table(examples(spark, docs, seed), "examples")
    trees = fitted(rows.filter("NOT held"), [*FEATURES])
    # Of the held-out candidates the numbers by kind, label and score, to a ten-thousandth.
    score = F.expr(trees.sql([*FEATURES]))
    got = rows.filter("held").groupBy("kind", "y", "real", F.floor(score * SCORES).cast("long").alias("q")).agg(F.sum("n").alias("n")).collect()
    kinds, q, y, n, real = (np.array([r[k] for r in got]) for k in ("kind", "q", "y", "n", "real"))
    own = {k: np.array([x == k for x in kinds], bool) for k, _ in GENERATORS}
    cuts = {k: threshold(q[i] / SCORES, y[i], PRECISION, n[i]) for k, i in own.items()}
    said = np.array([a / SCORES >= cuts[k] for a, k in zip(q, kinds)], bool)
    right = n[said & (y == 1) & (real == 1)].sum()
    return Model(trees.sql([f"x.{k}" for k in FEATURES]), tuple(cuts.items()), float(right / max(n[said & (real == 1)].sum(), 1)), float(right / max(n[(y == 1) & (real == 1)].sum(), 1)))


def _meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def chosen(found: Model) -> Column:
    """Of `_described` the candidates over their kind's threshold, with their score."""
    # The expression is parsed once with x as a column of the lambda below.
    scored = F.expr(f"transform(_described, x -> named_struct('start', x.start, 'rank', x.rank, 'kind', x.kind, 'end', x.end, 'value', x.value, 'score', {found.sql}))")
    return F.filter(scored, lambda s: reduce(lambda a, b: a | b, ((s["kind"] == k) & (s["score"] >= cut) for k, cut in found.cuts)))


def free(candidates: Column, base: Column) -> Column:
    """The candidates that meet no base span, and of those that meet one another the better first: by score, then place."""
    apart = F.filter(candidates, lambda s: ~F.exists(base, lambda b: _meets(s, b)))
    best = F.transform(F.array_sort(F.transform(apart, lambda s: F.struct((-s["score"]).alias("cost"), s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))),
                       lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.aggregate(best, F.array().cast(spans.TAGGED), lambda kept, s: F.when(F.exists(kept, lambda k: _meets(k, s)), kept).otherwise(F.concat(kept, F.array(s))))


def detect(spark: SparkSession, docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs with text: the `keep` columns, `_text` (null texts empty) and `_spans`, tagged and sorted.

    A null or empty text has no spans. Each row is treated alone, so repeated rows and null ids are as any other; other
    columns are not read; a very long text is searched whole; an empty table gives no rows.
    """
    text = F.col("_text")
    found = model(spark, docs)
    rows = docs.select(*(F.col(k) for k in keep), text_or_empty().alias("_text"))
    rows = rows.withColumn("_base", base_spans(text)).withColumn("_found", proposals(text))
    rows = rows.withColumn("_described", F.when(F.size("_found") > 0, described(text, F.col("_found"))).otherwise(described(F.lit(""), F.array().cast(spans.TAGGED))))
    nothing = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string,score:double>>")
    rows = rows.withColumn("_chosen", F.when(F.size("_found") > 0, chosen(found)).otherwise(nothing))
    plain = F.when(F.size("_chosen") > 0, free(F.col("_chosen"), F.col("_base"))).otherwise(F.array().cast(spans.TAGGED))
    return rows.withColumn("_spans", F.array_sort(F.concat("_base", plain))).select(*keep, "_text", "_spans")


def redacted(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of spans that overlap the first is named."""
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        kept = F.substr(text, a["at"] + 1, s["start"] - a["at"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], F.array(kept, F.concat(F.lit("<"), s["kind"], F.lit(">"))))).otherwise(a["out"]).alias("out"))

    done = F.aggregate(found, nothing, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1, F.greatest(F.char_length(text) - a["at"], F.lit(0)))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def op6_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its personal data's counts and places."""
    base = F.filter("_spans", lambda s: s["kind"].isin(*BASE))
    return detect(spark, documents(spark, sf_dir), ["doc_id"]).select(
        "doc_id", *(spans.count_kind(F.col("_spans"), k).alias(f"n_{k}") for k in BASE),
        spans.digest(base).alias("base_sha256"), spans.listed(F.col("_spans")).alias("spans"),
    )
