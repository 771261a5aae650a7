"""Near copies of the pipeline against brute force over exact shingle sets."""

import random

from loomgraph.llm import common, copies, simhash, stages

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def _text(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def _edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"e{r.randrange(10**9)}"
    return words


def _docs():
    """Edited copies on both sides of 0.8, a chain of edits, a large group, exact copies, short and empty texts."""
    r, texts = random.Random(5), []
    for i in range(60):
        base = _text(r, 200)
        texts += [base, _edited(r, base, i % 12)]
    chain = _text(r, 300)
    for _ in range(30):
        texts.append(chain)
        chain = _edited(r, chain, 3)
    hub = _text(r, 250)
    texts += [_edited(r, hub, 3) for _ in range(150)]
    texts += [texts[0]] * 20 + [["a", "B"], ["A", "b"], ["a"], [], []]
    rows = [(i, " ".join(t), "en", "web", 1) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return [*rows, (None, None, "en", "web", None), (None, " ".join(texts[2]), "en", "web", None)]


def _set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else None


def _kept(rows):
    order = sorted((r for r in rows if _set(r[1])), key=lambda r: (r[0] is None, r[0]))
    sets, top = [_set(r[1]) for r in order], list(range(len(order)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return [order[i][0] for i in range(len(order)) if top[i] == i] + [r[0] for r in rows if not _set(r[1])]


def test_near_copies_by_shingles(spark):
    rows = _docs()
    out = stages.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), "")
    assert out.columns == stages.COLUMNS
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(map(str, _kept(rows)))


def test_an_edited_copy_beyond_two_bits_goes(spark):
    r = random.Random(1)
    base = _text(r, 100)
    a, b = " ".join(base), " ".join(base[:97] + ["x", "y", "z"])
    assert bin((simhash.fingerprint(a) ^ simhash.fingerprint(b)) & (1 << 64) - 1).count("1") > 2
    out = stages.drop_near_copies(spark, spark.createDataFrame([(2, b, "en", "s", 1), (1, a, "en", "s", 1)], SCHEMA), "")
    assert [x["doc_id"] for x in out.collect()] == [1]


def test_what_neighbours_leave_apart_is_compared(spark):
    posted = [(7, s) for s in range(6)] + [(8, 9), (8, 10)]
    df = spark.createDataFrame(posted, "key long, set long")
    labels = spark.createDataFrame([(s, 0) for s in range(4)] + [(9, 9), (10, 9)], "node long, label long")

    def pairs(n, grams):
        sized = spark.createDataFrame([(s, n.get(s, 20)) for s in range(11)], "set long, n long")
        rows = spark.createDataFrame([(s, t) for s in range(6) for t in grams(s)], "set long, t int")
        return {tuple(x) for x in copies.apart(df, labels, sized, lambda some: rows, common.Workspace(spark, "t")).collect()}

    copies_rare, copies.RARE = copies.RARE, 2
    try:
        assert pairs({}, lambda s: range(20)) == {(a, b) for b in (4, 5) for a in range(b)}
        # Set 5 has five shingles of its own; 0 is too small for 4.
        assert pairs({0: 14}, lambda s: [*range(15), *range(1000, 1005)] if s == 5 else range(14 if s == 0 else 20)) == {(a, 4) for a in (1, 2, 3)}
        # 4 and 5 are alike in rare shingles, and in them alone.
        assert pairs({}, lambda s: range(100, 120) if s > 3 else range(20)) == {(4, 5)}
    finally:
        copies.RARE = copies_rare


def test_a_large_group_of_edited_copies_makes_few_pairs(spark):
    """Most of it is unlike the rest: not all pairs of the group are compared, and none that is alike is missed."""
    r = random.Random(11)
    base = _text(r, 146)
    texts = [_edited(r, base, r.choice([0, 1, 2, 4, 6, 8])) for _ in range(300)]
    rows = [(i, " ".join(t), "en", "web", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id AS rid", "doc_id AS place", "text")
    sets = copies.sketches(docs).selectExpr("set", "rid", "n").dropDuplicates(["set"])
    of = {x["rid"]: x["set"] for x in sets.collect()}
    every = [_set(" ".join(t)) for t in texts]
    posted = sets.selectExpr("1L AS key", "set")
    labels = spark.createDataFrame([], "node long, label long")
    got = {tuple(x) for x in copies.apart(posted, labels, sets, lambda some: copies.shingled(some, docs), common.Workspace(spark, "t")).collect()}
    alike = {tuple(sorted((of[i], of[j]))) for i in of for j in of if i < j and 5 * len(every[i] & every[j]) >= 4 * len(every[i] | every[j])}
    assert alike <= got and len(got) < len(of) ** 2 / 4
