"""Lines shared by documents, and ranked search, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import lines, queries, search
from loomgraph.llm.common import Workspace

from test_operators import CLASH, SCHEMA, corpus, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of_lines():
    """Lines on both sides of the threshold, in cases and spaces that make one key, repeated in a text, and a hot one."""
    r = random.Random(3)
    rows = corpus()
    for i in range(40):
        parts = [words(r, 5), "  Shared By All\t", "É not é" if i % 2 else "é NOT é", "", "  "]
        parts += ["in nine"] * 3 if i < 9 else []
        parts += ["\x0bIn Ten\x0c", "in ten"] if i < 10 else []
        parts += [" kept space"] if i % 2 else ["kept space"] * 2
        r.shuffle(parts)
        rows.append((1000 + i if i % 13 else None, "\n".join(parts), "en", "s1", 0))
    rows += [(2000, "\n".join(["shared by all", words(r, 40_000)] * 3), "en", "s2", 0), (2001, "\n", "en", "s2", 0), (2001, "\n", "en", "s2", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows_of_lines(), SCHEMA)
    for c in [*CLASH, "n_lines", "kept", "salt", "gone", "rank", "score", "query"]:
        df = df.selectExpr("*", f"'clash' AS {c}")
    return df.repartition(5)


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def plainly(rows, least):
    held = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t, *_ in rows:
        ls = (t or "").split("\n")
        left = [x for x in ls if not held[key(x)] >= least]
        out.append((i, len(ls), len(ls) - len(left), "\n".join(left)))
    return Counter(out)


@pytest.mark.parametrize("way", [{}, {"sent_bytes": 0}, {"bits": 1 << 16}])
@pytest.mark.parametrize("least", [2, 10])
def test_lines(spark, docs, least, way):
    out = lines.dedup(docs, Workspace(spark, "t"), ["doc_id"], least, **way)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept_text"]
    assert Counter(tuple(r) for r in out.collect()) == plainly(rows_of_lines(), least)


def test_first_line_stays(spark, docs):
    rows = rows_of_lines()
    kept = [r["kept_text"] for r in lines.dedup(docs, Workspace(spark, "t"), ["doc_id"], 10, first=True).collect()]
    held = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    left = Counter(key(x) for t in kept for x in t.split("\n"))
    assert all(left[k] == 1 for k, n in held.items() if n >= 10) and all(left[k] for k in held)
    first = min((r for r in rows if "shared by all" in key((r[1] or "").replace("\n", " "))), key=lambda r: (r[0] is None, r[0]))
    got = lines.dedup(docs.filter("doc_id = %d" % first[0]).unionAll(docs.filter("doc_id > %d" % first[0])), Workspace(spark, "t"), ["doc_id"], 10, first=True)
    assert [r["doc_id"] for r in got.collect() if "shared by all" in r["kept_text"].lower()] == [first[0]]


def test_second_filter_misses_nothing(spark, docs):
    """Every key of two rows is suspected, also where the filter is small; a large one suspects few others."""
    rows = rows_of_lines()
    held = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    for bits, wrong in ((1 << 16, 1.0), (1 << 20, 0.02)):
        twice = lines.twice_seen(docs, bits)
        found = {k.decode() for k in lines.suspected([k.encode() for k in held], twice)}
        assert {k for k, n in held.items() if n > 1} <= found
        assert len(found - {k for k, n in held.items() if n > 1}) <= wrong * len(held)


def test_a_task_with_many_lines(spark, docs, monkeypatch):
    monkeypatch.setattr(lines, "GATHERED", 7)
    assert Counter(tuple(r) for r in lines.dedup(docs, Workspace(spark, "t"), ["doc_id"]).collect()) == plainly(rows_of_lines(), 10)


def test_no_lines(spark, docs):
    none = docs.limit(0)
    assert lines.dedup(none, Workspace(spark, "t"), ["doc_id"]).collect() == []
    assert lines.dedup(none, Workspace(spark, "t"), ["doc_id"], sent_bytes=-1).collect() == []


def test_op11_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((i, a, b, hashlib.sha256(t.encode()).hexdigest()) for (i, a, b, t), n in plainly(rows_of_lines(), 10).items() for _ in range(n))
    got = queries.queries()["op11_bloom_lines"](spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got) == want


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked_plainly(rows, items, k=10):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows if terms(t)]
    n_docs, total = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for i, bag, n in bags:
            m = 25 + (75 * n * n_docs) // total
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t, times in Counter(terms(text)).items() if t in bag)
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(item, rank, i, s) for rank, (_, _, i, s) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


def asked():
    r = random.Random(9)
    return [(i, words(r, r.randint(1, 40))) for i in range(12)] + [(3, "the same item again the the"), (None, "onthe inat É日本 🙂"), (50, ""), (51, None), (52, "zzz --- \x00"), (53, words(r, 3000)), (54, "The THE the"), (1, words(r, 2))]


@pytest.fixture(scope="module")
def items(spark):
    df = spark.createDataFrame(asked(), "item_id BIGINT, text STRING")
    for c in ["asked", "query", "of", "doc_id", "rank", "score"]:
        df = df.selectExpr("*", f"'clash' AS {c}")
    return df


@pytest.mark.parametrize("limits", [{}, {"shard": 50}, {"shard": 400, "block_chars": 300}])
def test_search(spark, docs, items, limits):
    got = search.search(docs, items, **limits)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == ranked_plainly([(i, t) for i, t, *_ in rows_of_lines()], asked())


def test_search_of_nothing(spark, docs, items):
    assert search.search(docs.limit(0), items).collect() == [] and search.search(docs, items.limit(0)).collect() == []
    assert search.search(docs.filter("text = ''"), items).collect() == []


def test_bound_ends_a_query_early():
    """Rare terms decide: the postings of a common term are hardly read, and the scores are complete."""
    r = np.random.default_rng(4)
    n, k = 20_000, 10
    rare = r.choice(n, 60, replace=False)
    doc, term = np.r_[np.arange(n), rare], np.r_[np.zeros(n, int), np.ones(60, int)]
    part = r.integers(50, 1000, len(doc))
    part[n:] += 5000
    held = search.Postings(doc, term, part, 2, n)
    weights, order = np.array([3, 9000]), np.arange(n)
    at, score, read = held.best(np.array([0, 1]), weights, k, order)
    whole = np.bincount(doc, part * weights[term], n).astype(int)
    want = np.lexsort((order, -whole))[:k]
    assert at.tolist() == want.tolist() and score.tolist() == whole[want].tolist()
    assert read < n / 10


@pytest.mark.parametrize("seed", range(5))
def test_random_postings_with_ties(seed):
    r = np.random.default_rng(seed)
    n, n_terms = 300, 12
    pairs = np.unique(r.integers(0, n * n_terms, 1500))
    doc, term, part = pairs // n_terms, pairs % n_terms, r.integers(1, 4, len(pairs)) * 10
    held, order = search.Postings(doc, term, part, n_terms, n), r.permutation(n)
    for _ in range(20):
        terms_, weights = np.unique(r.choice(n_terms, r.integers(1, 6))), r.integers(0, 4, 0)
        weights = r.integers(0, 4, len(terms_))
        whole = sum(np.bincount(doc[term == t], part[term == t] * w, n) for t, w in zip(terms_, weights)).astype(int)
        want = [i for i in np.lexsort((order, -whole)) if whole[i] > 0][:10]
        at, score, _ = held.best(terms_, weights, 10, order)
        assert at.tolist() == want and score.tolist() == whole[want].tolist()
