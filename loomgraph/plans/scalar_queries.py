"""Queries of the sequence functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from . import sql as Q
from .adapters import dna, table

NEEDLE = "TATA"
_TEXT = Q.up("text")
_W = "regexp_replace(text, '[^A-Za-z0-9+ ]', '', 'g')"


def _docs(spark, d):
    return table(spark, d, "documents")


def _digest(df, **cols):
    return df.select("doc_id", *(c.alias(k) for k, c in cols.items()))


def _kinds(spark, d):
    p = table(spark, d, "part")
    seq = F.repeat(F.substr("p_name", F.lit(1), (F.col("p_size") % 7 + 1).cast("int")), (F.col("p_size") % 9 + 1).cast("int"))
    return p.select("p_partkey", S.upper(seq).alias("seq"), (F.col("p_size") % 11 == 0).alias("bb"))


_SEQ = f"{Q.up('repeat(substr(p_name, 1, p_size % 7 + 1), p_size % 9 + 1)')}"
_KINDS = f"WITH k AS (SELECT p_partkey, {_SEQ} AS seq, p_size % 11 = 0 AS bb FROM part), t AS (SELECT *, length(seq) >= 6 AND (" + " OR ".join(
    f"(length(seq) >= {4 * p} AND len(list_filter(range({p}, greatest(length(seq), {p})), lambda i: substr(seq, CAST(i + 1 AS INTEGER), 1) = substr(seq, CAST(i - {p} + 1 AS INTEGER), 1))) / nullif(CAST(length(seq) - {p} AS DOUBLE), 0) > 0.82)" for p in range(1, 7)
) + ") AS tandem FROM k) "
_NAMES = "c_name || '#' || c_custkey || '#chr' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN ':' || (c_custkey * 1000) || '-9' ELSE ':x' || c_custkey END"


def _names(spark, d):
    k = F.col("c_custkey")
    tail = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit(":"), (k * 1000).cast("string"), F.lit("-9"))).otherwise(F.concat(F.lit(":x"), k.cast("string")))
    return table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit("#"), k.cast("string"), F.lit("#chr"), F.col("c_nationkey").cast("string"), tail).alias("name"))


def _find(spark, d):
    return dna(spark, d).select("doc_id", F.coalesce(S.find("seq", F.lit(NEEDLE)), F.lit(-1).cast("long")).alias("first"))


def _sig(spark, d):
    return table(spark, d, "orders").select("o_orderkey", _sig_text().alias("sig"), S.significance(_sig_text()).alias("bucket"))


def _sig_text():
    k = F.col("o_orderkey") % 8
    out = F
    for i, t in enumerate(("Pathogenic", "pathogenic/benign", "risk factor", "drug response", "Uncertain significance", "Likely benign", "protective")):
        out = out.when(k == i, t)
    return out.otherwise(F.col("o_orderpriority"))


_SIG = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(("Pathogenic", "pathogenic/benign", "risk factor", "drug response", "Uncertain significance", "Likely benign", "protective"))) + " ELSE o_orderpriority END"
_CLASS = "CASE WHEN a IN ('A','V','L','I','M','F','W','C') THEN 'hydrophobic' WHEN a IN ('S','T','N','Q','Y') THEN 'polar' WHEN a IN ('K','R','H') THEN 'positive' WHEN a IN ('D','E') THEN 'negative' WHEN a IN ('G','P') THEN 'special' WHEN a = '*' THEN 'stop' ELSE 'other' END"
_STRICT = f"CASE WHEN length(c) < 3 THEN '' WHEN regexp_full_match(c, '[ACGT]{{3}}') THEN {Q.amino('c')} ELSE 'X' END"


_ALL_CODONS = f"SELECT doc_id, unnest({Q.codons('t', 0)}) AS c FROM (SELECT doc_id, {_TEXT} AS t FROM documents)"


def _counts(strict=False, kind=False):
    """Amino acids of all codons of frame 0 of each whole text, whatever its letters."""

    def plan(s, d):
        # Letters are folded first, for the strict table too.
        out = _docs(s, d).select("doc_id", F.explode(S.aminos(S.upper("text"), 0, strict)).alias("aa")).groupBy("doc_id", "aa").agg(F.count("*").alias("n"))
        return out.withColumn("kind", S.amino_class("aa")) if kind else out

    return plan


def _global_frame(spark, d):
    """Codons whose places, counted from the document's number, are multiples of three: from the first of them on, whole ones."""
    first = F.pmod(-F.col("doc_id"), F.lit(3)).cast("int") + 1
    rows = dna(spark, d).select("doc_id", F.explode(S.aminos(F.substr(F.col("seq"), first), 0, True)).alias("aa"))
    return rows.groupBy("doc_id", "aa").agg(F.count("*").alias("n"))


QUERIES = {
    "f1_upper": (lambda s, d: _digest(_docs(s, d), n=S.length("text"), digest=F.md5(S.upper("text"))), f"SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n, md5({_TEXT}) AS digest FROM documents"),
    "f2_complement": (lambda s, d: _digest(_docs(s, d), digest=F.md5(S.complement("text"))), f"SELECT doc_id, md5({Q.comp('text')}) AS digest FROM documents"),
    "f3_revcomp": (lambda s, d: _digest(_docs(s, d), digest=F.md5(S.reverse_complement("text"))), f"SELECT doc_id, md5({Q.rc('text')}) AS digest FROM documents"),
    "f4_strand": (
        lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).select("l_returnflag", "l_linestatus", "n", S.flip(F.when(F.col("l_returnflag") == "R", "-").otherwise("+")).alias("flipped"), S.sign(F.when(F.col("l_returnflag") == "R", "-x").when(F.col("l_returnflag") == "A", "").otherwise("?")).alias("parsed")),
        "SELECT l_returnflag, l_linestatus, count(*) AS n, CASE WHEN l_returnflag = 'R' THEN '+' ELSE '-' END AS flipped, CASE WHEN l_returnflag = 'R' THEN '-' WHEN l_returnflag = 'A' THEN '+' END AS parsed FROM lineitem GROUP BY 1, 2",
    ),
    "f5_codon": (_counts(), f"SELECT doc_id, {Q.amino('c')} AS aa, count(*) AS n FROM ({_ALL_CODONS}) GROUP BY 1, 2"),
    "f6_translate": (
        lambda s, d: _digest(dna(s, d), **{f"p{k}": F.md5(S.translate("seq", k)) for k in range(3)}),
        Q.DNA + "SELECT doc_id, " + ", ".join(f"md5(array_to_string(list_transform({Q.codons('seq', k)}, lambda c: {Q.amino('c')}), '')) AS p{k}" for k in range(3)) + " FROM dna",
    ),
    "f7_codons": (lambda s, d: _digest(dna(s, d), n=F.size(S.codons("seq", 1)), digest=F.md5(F.array_join(S.codons("seq", 1), ","))), Q.DNA + f"SELECT doc_id, CAST(len({Q.codons('seq', 1)}) AS INTEGER) AS n, md5(array_to_string({Q.codons('seq', 1)}, ',')) AS digest FROM dna"),
    "f8_strict_codon": (_counts(True), f"SELECT doc_id, {_STRICT} AS aa, count(*) AS n FROM ({_ALL_CODONS}) GROUP BY 1, 2"),
    "f9_global_frame": (
        _global_frame,
        Q.DNA + f"SELECT doc_id, aa, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(list_filter(range(0, greatest(length(seq) - 2, 0)), lambda i: (doc_id + i) % 3 = 0), lambda i: {Q.amino('substr(seq, CAST(i + 1 AS INTEGER), 3)')})) AS aa FROM dna) GROUP BY 1, 2",
    ),
    "f10_find": (_find, Q.DNA + f"SELECT doc_id, CAST(strpos(seq, '{NEEDLE}') - 1 AS BIGINT) AS first FROM dna"),
    "f11_count": (lambda s, d: _digest(dna(s, d), n=S.count("seq", F.lit(NEEDLE))), Q.DNA + f"SELECT doc_id, CAST(len({Q.offsets('seq', repr(NEEDLE))}) AS BIGINT) AS n FROM dna"),
    "f12_offsets": (lambda s, d: dna(s, d).select("doc_id", F.explode(S.offsets("seq", F.lit(NEEDLE)).cast("array<bigint>")).alias("at")), Q.DNA + f"SELECT doc_id, unnest({Q.offsets('seq', repr(NEEDLE))}) AS at FROM dna"),
    "f13_tandem": (lambda s, d: _kinds(s, d).select("p_partkey", S.tandem("seq").alias("tandem")), _KINDS + "SELECT p_partkey, coalesce(tandem, false) AS tandem FROM t"),
    "f14_kind": (lambda s, d: _kinds(s, d).select("p_partkey", S.kind("seq", "bb").alias("kind")), _KINDS + "SELECT p_partkey, CASE WHEN bb THEN 'backbone' WHEN coalesce(tandem, false) THEN 'tandem' WHEN strlen(seq) >= 250 THEN 'large' WHEN strlen(seq) <= 4 THEN 'snp' ELSE 'indel' END AS kind FROM t"),
    "f15_preview": (lambda s, d: _digest(dna(s, d), preview=S.preview("seq")), Q.DNA + "SELECT doc_id, CASE WHEN length(seq) <= 24 THEN seq ELSE substr(seq, 1, 12) || '…' || right(seq, 8) END AS preview FROM dna"),
    "f16_region": (
        lambda s, d: _names(s, d).select("c_custkey", S.chromosome("name").alias("chrom"), S.region_start("name").alias("start")),
        f"WITH n AS (SELECT c_custkey, string_split({_NAMES}, '#')[-1] AS tail FROM customer) SELECT c_custkey, string_split(tail, ':')[1] AS chrom, coalesce(TRY_CAST(string_split(string_split(tail, ':')[2], '-')[1] AS BIGINT), 0) AS start FROM n",
    ),
    "f17_sample": (lambda s, d: _names(s, d).select("c_custkey", S.sample("name").alias("sample")), f"WITH n AS (SELECT c_custkey, string_split({_NAMES}, '#') AS p FROM customer) SELECT c_custkey, p[1] || '#' || p[2] AS sample FROM n"),
    "f18_commas": (lambda s, d: table(s, d, "orders").select("o_orderkey", S.commas((F.col("o_orderkey") - 500) * 7919).alias("text")), "SELECT o_orderkey, format('{:,}', (o_orderkey - 500) * 7919) AS text FROM orders"),
    "f19_json_text": (lambda s, d: _docs(s, d).select("doc_id", F.md5(F.to_json(F.struct("text"))).alias("digest")), "SELECT doc_id, md5(to_json({'text': text})) AS digest FROM documents"),
    "f20_significance": (
        _sig,
        f"WITH t AS (SELECT o_orderkey, {_SIG} AS sig FROM orders) SELECT o_orderkey, sig, CASE WHEN lower(sig) LIKE '%pathogenic%' AND lower(sig) NOT LIKE '%benign%' THEN 'pathogenic' WHEN regexp_matches(lower(sig), 'risk|association|protective|affects') THEN 'risk' WHEN lower(sig) LIKE '%drug%' THEN 'drug' WHEN regexp_matches(lower(sig), 'uncertain|conflicting|not provided') THEN 'uncertain' WHEN lower(sig) LIKE '%benign%' THEN 'benign' ELSE 'other' END AS bucket FROM t",
    ),
    "f21_amino_class": (_counts(False, True), f"SELECT doc_id, a AS aa, n, {_CLASS} AS kind FROM (SELECT doc_id, {Q.amino('c')} AS a, count(*) AS n FROM ({_ALL_CODONS}) GROUP BY 1, 2)"),
    "f22_query_text": (lambda s, d: table(s, d, "part").select("p_partkey", S.query_text(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("q")), "SELECT p_partkey, CASE WHEN length(q) >= 2 THEN q END AS q FROM (SELECT p_partkey, regexp_replace(upper(trim(p_name)), '[^ACGTN]', '', 'g') AS q FROM part)"),
    "f23_zigzag": (lambda s, d: table(s, d, "lineitem").select(S.zigzag(F.col("l_partkey") - F.col("l_suppkey")).alias("z")).groupBy("z").agg(F.count("*").alias("n")), "SELECT CAST(CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS BIGINT) AS z, count(*) AS n FROM (SELECT l_partkey - l_suppkey AS v FROM lineitem) GROUP BY 1"),
    "f24_bits_for": (lambda s, d: table(s, d, "part").select("p_partkey", S.bits_for("p_partkey").alias("bits")), "SELECT p_partkey, CASE WHEN p_partkey <= 1 THEN 1 ELSE length(bin(p_partkey - 1)) END AS bits FROM part"),
    "f25_effective_order": (
        lambda s, d: table(s, d, "part").select("p_partkey", S.effective_order((F.col("p_partkey") % 20).cast("int"), (F.col("p_size") % 9).cast("int")).alias("k")),
        "SELECT p_partkey, CAST(CASE WHEN p_size % 9 = 0 THEN 0 ELSE least(p_partkey % 20, 56 // (p_size % 9)) END AS INTEGER) AS k FROM part",
    ),
}
