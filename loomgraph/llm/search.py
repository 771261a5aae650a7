"""Ranked lexical search over impact-ordered postings, score at a time.

A shard is a run of documents that one task reads. Its postings of the queries' terms are grouped by impact: what a
posting adds to a score, exact and whole. A query takes the groups of all its terms in descending order of impact and adds
them up. What no group can add any more bounds every document's score; once the k-th best sum so far shows that no other
document can reach the best k, the groups left are not read, and only the candidates' scores are completed. Shards
hand on their best k a query, so nothing but those, and counts by term, is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import documents, in_arrow

K = 10
#: Postings of a shard that are held at a time; a document's postings stay together.
SHARD_POSTINGS = 1_000_000
#: Queries are sent to all workers in blocks of at most so many characters, each block with scans of its own.
BLOCK_CHARS = 8_000_000
#: Impacts down to this share of the greatest one left are read before the bound is looked at again.
STEP = 0.75
#: Candidates, in multiples of k, whose scores are completed rather than read on.
NEAR = 4
#: Bytes that are no part of a term become spaces, A to Z lower-case; bytes of other characters than ASCII are parts of terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


@dataclass
class Query:
    """A query's place in its block, its different terms by number, and how often it holds each."""

    place: int
    terms: np.ndarray
    times: np.ndarray


class Postings:
    """A shard's postings. Those of term t are at start[t]:start[t + 1], greatest part first; again by document and term.

    A posting's impact is its part times its term's weight in the query, so equal parts of a term are a group of one impact.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, part: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((doc, -part, term))
        self.start, self.doc, self.down = np.searchsorted(term[order], np.arange(n_terms + 1)), doc[order], -part[order]
        key = doc.astype(np.int64) * n_terms + term
        order = np.argsort(key, kind="stable")
        self.key, self.key_part, self.n_terms, self.n_docs = key[order], part[order], n_terms, n_docs

    def completed(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of the documents."""
        key = docs[:, None].astype(np.int64) * self.n_terms + terms
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return (np.where(self.key[at] == key, self.key_part[at], 0) * weights).sum(axis=1)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents and their scores, above 0, equal ones by `order`; and how many postings were read.

        weights: of each term, times its occurrences in the query.
        """
        some = (weights > 0) & (self.start[terms + 1] > self.start[terms])
        terms, weights = terms[some], weights[some]
        at, end, sums = self.start[terms], self.start[terms + 1], np.zeros(self.n_docs, np.int64)
        near, read = np.zeros(0, np.int64), 0
        while len(terms):
            heads = np.where(at < end, -self.down[np.minimum(at, len(self.down) - 1)] * weights, 0)
            level = max(int(heads.max() * STEP), 1)
            for i in np.flatnonzero(heads >= level):
                # Whole groups: every posting of this term whose impact is not below the level, a document once.
                down = self.down[at[i] : end[i]]
                n = int(np.searchsorted(down, level // -int(weights[i]), side="right"))
                sums[self.doc[at[i] : at[i] + n]] -= down[:n] * weights[i]
                at[i] += n
                read += n
            rest = int(np.where(at < end, -self.down[np.minimum(at, len(self.down) - 1)] * weights, 0).sum())
            kth = int(np.partition(sums, self.n_docs - k)[self.n_docs - k]) if self.n_docs > k else 0
            # A document without a sum gets `rest` at most, and others `rest` more at most than they have.
            if not rest or rest < kth:
                near = np.flatnonzero((sums > 0) & (sums + rest >= kth))
                if not rest or len(near) <= NEAR * k:
                    break
        scores = self.completed(near, terms, weights) if len(near) else near
        first = np.lexsort((order[near], -scores))[:k]
        return near[first], scores[first], read


def statistics(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents that hold a term, all their terms, and how many documents hold each term of the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, some, total = sent.value, 0, 0
        held = np.zeros(len(known), np.int64)
        for b in batches:
            for text in b.column(0):
                terms = terms_of(text.as_py())
                some, total = some + bool(terms), total + len(terms)
                held[[known[t] for t in known.keys() & set(terms)]] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()]), pa.array([some, total, *held[at].tolist()])], ["term", "n"])

    sums = {r["term"]: r["n"] for r in in_arrow(docs.select("text"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(len(vocabulary), np.int64)
    for t, n in sums.items():
        if t >= 0:
            df[t] = n
    return sums.get(-2, 0), sums.get(-1, 0), df


def search(docs: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD_POSTINGS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs (doc_id, text), queries (item_id, text): (item_id, rank, doc_id, score), the k best documents of each query.

    Every row of either table counts: a repeated row is a document, or a query with ranks, of its own. Equal scores go by
    doc_id, null last; rows that are equal in both are alike. Null and empty texts hold no term: as queries they find
    nothing, as documents they are never found, and they aren't counted. A very long text is read whole. doc_id is a whole
    number. Other columns are not read; an empty table gives no rows.
    """
    asked = queries.select("item_id", F.col("text").alias("asked")).filter(F.char_length("asked") > 0)
    blocks = -(-(asked.agg(F.sum(F.char_length("asked"))).collect()[0][0] or 0) // block_chars)
    out = docs.limit(0).join(asked.limit(0)).select("item_id", F.lit(0).alias("rank"), F.col("doc_id").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("asked"), F.lit(blocks)) == b).collect()
        out = out.union(_searched(docs.select("doc_id", "text"), [r["item_id"] for r in rows], [r["asked"] for r in rows], queries.schema["item_id"], k, shard))
    return out


def _searched(docs: DataFrame, items: list, texts: list[str], item_field, k: int, shard: int) -> DataFrame:
    spark, vocabulary, block = docs.sparkSession, {}, []
    for i, text in enumerate(texts):
        numbers, times = np.unique([vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text)], return_counts=True)
        if len(numbers):
            block.append(Query(i, numbers.astype(np.int64), times))
    some, total, df = statistics(docs, vocabulary)
    weights = np.array([math.floor(1000 * math.log((2 * some + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    sent = spark.sparkContext.broadcast((vocabulary, block, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked, weight = sent.value
        ids: list[int | None] = []
        doc, term, part = [], [], []

        def best() -> pa.RecordBatch:
            held = Postings(np.concatenate(doc), np.concatenate(term), np.concatenate(part), len(known), len(ids))
            number = np.array([0 if i is None else i for i in ids], np.int64)
            order = np.empty(len(ids), np.int64)
            order[np.lexsort((number, [i is None for i in ids]))] = np.arange(len(ids))
            found = []
            for q in asked:
                at, score, _ = held.best(q.terms, weight[q.terms] * q.times, k, order)
                found += [(q.place, ids[i], s) for i, s in zip(at.tolist(), score.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], []))], ["query", "doc_id", "score"])

        n = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                terms = terms_of(text.as_py())
                mine = [known[t] for t in terms if t in known]
                if not mine:
                    continue
                m = 25 + 75 * len(terms) * some // total
                numbers, tf = np.unique(mine, return_counts=True)
                doc.append(np.full(len(numbers), len(ids), np.int32))
                term.append(numbers.astype(np.int32))
                part.append(1_000_000_000 * tf.astype(np.int64) // (1000 * tf + 8 * m))
                ids.append(doc_id)
                n += len(numbers)
                if n >= shard:
                    yield best()
                    ids, doc, term, part, n = [], [], [], [], 0
        if ids:
            yield best()

    found = in_arrow(docs, run, "query long, doc_id long, score long")
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([*enumerate(items)], StructType([StructField("of", LongType()), item_field]))
    return ranked.join(names, F.col("query") == F.col("of")).select("item_id", "rank", "doc_id", "score")


def op12_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: What op12 returns, as DuckDB SQL.
OP12_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM t WHERE len(ts) > 0),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
q AS (SELECT row_number() OVER () AS qr, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
qt AS (SELECT qr, item_id, term, count(*) AS times FROM (SELECT qr, item_id, unnest(ts) AS term FROM q) GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS term FROM d) SEMI JOIN (SELECT DISTINCT term FROM qt) USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, nn),
i AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * nn) // ll)))) AS impact FROM p JOIN w USING (term), s),
c AS (SELECT qr, item_id, r, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM qt JOIN i USING (term) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""
