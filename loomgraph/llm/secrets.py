"""Secret scans through an inverted index of trigrams.

Each rule's pattern yields a Boolean query over lower-cased trigrams that every match must satisfy. The trigrams that
occur in any query are indexed: postings of text keys by trigram and block of keys. A rule's query is answered by
intersecting and uniting postings within each block; only the texts it returns are searched with the pattern. A rule
whose matches need no trigram reads every text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import documents, text_or_empty

#: name, pattern, group whose length counts, least length. The first three are the contract's.
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 0),
    ("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
]
BASE = ("assign", "access", "hex")
#: Same matches as the rule's pattern with its least length, but no match is begun that can't be long enough.
FAST = {"hex": r"[0-9a-f]{16,}+"}
#: Texts of one block of the index.
BLOCK_TEXTS = 4_096
#: Strings that a part of a pattern may stand for before they are turned into trigrams.
MAX_STRINGS = 64

#: A query is a conjunction; each term is a set of alternatives; each alternative is a set of trigrams, all needed.
Query = list[frozenset[frozenset[str]]]


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _term(strings: set[str]) -> Query:
    """What a text holding one of the strings must hold; nothing if one of them is too short to say."""
    options = {_grams(s) for s in strings}
    if frozenset() in options:
        return []
    return [frozenset(a for a in options if not any(b < a for b in options))]


def _either(queries: list[Query]) -> Query:
    """Holds if one of the queries does; weakened to the first term of each, which is enough to be necessary."""
    if not all(queries):
        return []
    options = frozenset().union(*(q[0] for q in queries))
    return [frozenset(a for a in options if not any(b < a for b in options))]


def _strings(node) -> set[str] | None:
    """All strings that the part matches, lower-cased, if they are few; else None."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN" and all(str(k) == "LITERAL" for k, _ in arg) and len(arg) <= 6:
        return {chr(v).lower() for _, v in arg}
    if op == "SUBPATTERN":
        return _sequence_strings(arg[3])
    if op == "BRANCH":
        each = [_sequence_strings(x) for x in arg[1]]
        return set().union(*each) if None not in each else None
    if op == "MAX_REPEAT" and arg[0] in (0, 1) and arg[1] == 1:
        inner = _sequence_strings(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _sequence_query(nodes) -> Query:
    out: Query = []
    held = {""}
    for node in nodes:
        more = _strings(node)
        if more is not None and len(held) * len(more) <= MAX_STRINGS:
            held = {a + b for a in held for b in more}
            continue
        out += _term(held)
        held = {""}
        op, arg = str(node[0]), node[1]
        if op == "SUBPATTERN":
            out += _sequence_query(arg[3])
        elif op == "BRANCH":
            out += _either([_sequence_query(x) for x in arg[1]])
        elif op == "MAX_REPEAT" and arg[0] >= 1:
            out += _sequence_query(arg[2])
    return out + _term(held)


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a pattern, on lower-cased text; [] if it needs no trigram."""
    return _sequence_query(re._parser.parse(pattern))


def vocabulary(queries: dict[str, Query]) -> list[str]:
    return sorted({t for q in queries.values() for term in q for option in term for t in option})


def trigrams(low: Column, words: list[str]) -> Column:
    """The different trigrams of the text that are in the vocabulary, all found in one pass over it.

    A match is empty, at a place that one of them begins; alternatives are gathered by their first character.
    """
    heads: dict[str, list[str]] = {}
    for t in words:
        heads.setdefault(t[0], []).append(re.escape(t[1:]))
    first = "".join(re.escape(h) for h in heads)
    pattern = f"(?=[{first}])(?=(" + "|".join(f"{re.escape(h)}(?:{'|'.join(tails)})" for h, tails in heads.items()) + "))"
    return F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)))


def postings(docs: DataFrame, words: list[str]) -> DataFrame:
    """docs (key, low): the inverted index (block, trigram, keys) of the vocabulary.

    A block has about BLOCK_TEXTS keys however common a trigram is, for keys are hashes.
    """
    blocks = max(1, -(-docs.count() // BLOCK_TEXTS))
    each = docs.select("key", F.explode(trigrams(F.col("low"), words)).alias("trigram")).withColumn("block", F.pmod("key", F.lit(blocks)))
    return each.groupBy("block", "trigram").agg(F.collect_set("key").alias("keys"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """postings(): (of, rules), the keys that satisfy some rule's trigram query, and those rules."""
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("at"))
    none = F.array().cast("array<bigint>")

    def keys(t: str) -> Column:
        return F.coalesce(F.element_at("at", F.lit(t)), none)

    def answer(query: Query) -> Column:
        terms = [reduce(F.array_union, [reduce(F.array_intersect, [keys(t) for t in sorted(option)]) for option in sorted(term, key=sorted)]) for term in query]
        return reduce(F.array_intersect, terms)

    def hit(name: str) -> Column:
        return F.transform(answer(queries[name]), lambda k: F.struct(k.alias("of"), F.lit(name).alias("rule")))

    hits = F.concat(*(hit(name) for name in queries))
    return blocks.select(F.explode(hits).alias("hit")).groupBy(F.col("hit.of").alias("of")).agg(F.collect_set("hit.rule").alias("rules"))


def scan(docs: DataFrame, rules: list[tuple[str, str, int, int]] = RULES) -> DataFrame:
    """docs (doc_id, text): (doc_id, spans), spans an array of (start, rank, kind, end, value) by start and rank.

    A null text is empty and has no spans; a row with any doc_id, null and repeated ones too, gives one row; equal texts of
    one id share a key; a very long text is searched whole, by patterns that don't recurse; spans of one start go by the
    rule's place in the list; other columns are not read; an empty table gives no rows.
    """
    queries = {name: trigram_query(pattern) for name, pattern, _, _ in rules}
    queries = {name: q for name, q in queries.items() if q}
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    texts = texts.withColumn("key", F.xxhash64("doc_id", "text"))  # equal keys of unequal texts only add candidates
    found = candidates(postings(texts.select("key", F.lower("text").alias("low")), vocabulary(queries)), queries)
    rows = texts.join(found, texts["key"] == found["of"], "left")
    each = []
    for rank, (name, pattern, group, least) in enumerate(rules):

        def keep(m: Column, pattern=pattern, group=group, least=least) -> Column:
            return F.char_length(F.regexp_extract(m, pattern, group) if group else m) >= least

        own = spans.tagged(spans.find(F.col("text"), FAST.get(name, pattern), keep if least else None), name, rank)
        each.append(F.when(F.array_contains("rules", F.lit(name)), own).otherwise(F.array().cast(spans.TAGGED)) if name in queries else own)
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def op2_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its secrets' counts and places."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return scan(documents(spark, sf_dir)).select(
        "doc_id", *(spans.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE),
        spans.digest(base).alias("base_sha256"), spans.listed(F.col("spans")).alias("spans"),
    )
