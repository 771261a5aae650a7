"""Functions on sequences as Column expressions: no Python runs on the executors.

Sequences are ASCII; letters are folded by ASCII rules only, and positions count bytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bases with a complement, and their complements in the same order; any other base gives N.
BASES, COMPLEMENTS = "ATUGCNRYSWKMBVDH", "TAACGNYRSWMKVBHD"
#: Amino acids of the standard genetic code, codons in TCAG order of first, second, third base.
AMINO_TCAG = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: First two bases after which any third one gives the same amino acid.
FOURFOLD = [a + b for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") if len(set(AMINO_TCAG[16 * i + 4 * j : 16 * i + 4 * j + 4])) == 1]
#: Amino acids by class.
AMINO_CLASSES = {"hydrophobic": "AVLIMFWC", "polar": "STNQY", "positive": "KRH", "negative": "DE", "special": "GP", "stop": "*"}
#: Patterns of clinical significance, in order of precedence.
SIGNIFICANCE = [
    ("pathogenic", r"pathogenic", r"benign"),
    ("risk", r"risk|association|protective|affects", None),
    ("drug", r"drug", None),
    ("uncertain", r"uncertain|conflicting|not provided", None),
    ("benign", r"benign", None),
]
TANDEM_PERIODS, TANDEM_LEAST, TANDEM_SHARE = 6, 6, 0.82
LARGE, SMALL = 250, 4
CONTEXT_BITS = 56


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def length(seq: Column | str) -> Column:
    """Bytes of a sequence."""
    return F.octet_length(_col(seq)).cast("long")


def upper(seq: Column | str) -> Column:
    return F.translate(_col(seq), LOWER, UPPER)


def complement(seq: Column | str) -> Column:
    return F.translate(F.regexp_replace(upper(seq), f"[^{BASES}]", "N"), BASES, COMPLEMENTS)


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def flip(strand: Column | str) -> Column:
    return F.when(_col(strand) == "-", "+").otherwise("-")


def sign(text: Column | str) -> Column:
    """Strand of a sign field by its first character: + if empty, null if neither sign."""
    first = F.substring(_col(text), 1, 1)
    return F.when((first == "") | (first == "+"), "+").when(first == "-", "-")


def oriented(seq: Column | str, strand: Column | str) -> Column:
    return F.when(_col(strand) == "-", reverse_complement(seq)).otherwise(_col(seq))


def _place(order: str, base: Column) -> Column:
    return F.position(base, F.lit(order)) - 1


def amino(codon: Column | str) -> Column:
    """Amino acid of a codon; X if unknown, but a third base that can't matter may be anything."""
    c = upper(codon)
    a, b, d = (F.substring(c, i, 1) for i in (1, 2, 3))
    known = F.substr(F.lit(AMINO_TCAG), (_place("TCAG", a) * 16 + _place("TCAG", b) * 4 + _place("TCAG", d) + 1).cast("int"), F.lit(1))
    family = F.substr(F.lit(AMINO_TCAG), (_place("TCAG", a) * 16 + _place("TCAG", b) * 4 + 1).cast("int"), F.lit(1))
    return (
        F.when(F.char_length(c) != 3, "X")
        .when(F.rlike(c, F.lit("^[ACGT]{3}$")), known)
        .when(F.substring(c, 1, 2).isin(*FOURFOLD), family)
        .otherwise("X")
    )


def amino_strict(codon: Column | str) -> Column:
    """Amino acid of a codon of plain bases, X otherwise; nothing for fewer than three characters."""
    c = _col(codon)
    return F.when(F.char_length(c) < 3, "").when(F.rlike(c, F.lit("^[ACGT]{3}$")), amino(c)).otherwise("X")


def codons(seq: Column | str, frame: int = 0) -> Column:
    """Whole codons from the frame on, in one pass."""
    return F.regexp_extract_all(_from(_col(seq), frame), F.lit("(?s).{3}"), F.lit(0))


def _from(s: Column, frame: int) -> Column:
    return F.substr(s, F.lit(frame + 1)) if frame else s


def _amino_table(strict: bool) -> str:
    """Amino acids by codon, its bases as the digits of a decimal number: T, C, A, G are 0 to 3 and anything else 4."""
    out = ["X"] * 445
    for i in range(125):
        a, b, c = i // 25, i // 5 % 5, i % 5
        known = max(a, b) < 4 and (c < 4 or not strict and "TCAG"[a] + "TCAG"[b] in FOURFOLD)
        if known:
            out[100 * a + 10 * b + c] = AMINO_TCAG[16 * a + 4 * b + c % 4]
    return "".join(out)


def aminos(seq: Column | str, frame: int = 0, strict: bool = False) -> Column:
    """Amino acids of the whole codons from the frame on, as an array: a look-up a codon, bases told apart once for all."""
    s = _from(_col(seq) if strict else upper(seq), frame)
    digits = F.translate(F.regexp_replace(s, "[^TCAG]", "N"), "TCAGN", "01234")
    table = F.split(F.lit(_amino_table(strict)), "")
    return F.transform(F.regexp_extract_all(digits, F.lit(".{3}"), F.lit(0)), lambda x: F.get(table, x.cast("int")))


def translate(seq: Column | str, frame: int = 0) -> Column:
    return F.array_join(aminos(seq, frame), "")


def translate_strict(seq: Column | str, frame: int = 0) -> Column:
    return F.array_join(aminos(seq, frame, True), "")


def amino_class(acid: Column | str) -> Column:
    a = _col(acid)
    return reduce(lambda w, kv: w.when(a.isin(*kv[1]), kv[0]), AMINO_CLASSES.items(), F).otherwise("other")


def find(seq: Column | str, needle: Column) -> Column:
    """First offset, or null; an empty needle is not found."""
    at = F.position(needle, _col(seq))
    return F.when((needle != "") & (at > 0), (at - 1).cast("long"))


def offsets(seq: Column | str, needle: Column) -> Column:
    """All offsets, overlapping ones too."""
    s = _col(seq)
    last = F.char_length(s) - F.char_length(needle)
    at = F.when((needle != "") & (last >= 0) & F.contains(s, needle), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: F.substr(s, i + 1, F.char_length(needle)) == needle)


def count(seq: Column | str, needle: Column) -> Column:
    return F.size(offsets(seq, needle)).cast("long")


def tandem(seq: Column | str) -> Column:
    """Whether the sequence mostly repeats itself at a period of one to six."""
    s, n = _col(seq), F.char_length(_col(seq))

    def at(p: int) -> Column:
        same = F.size(F.filter(F.sequence(F.lit(p), n - 1), lambda i: F.substr(s, i + 1, F.lit(1)) == F.substr(s, i - p + 1, F.lit(1))))
        return F.when((n >= 4 * p) & (n >= TANDEM_LEAST), same / (n - p) > TANDEM_SHARE).otherwise(False)

    return reduce(lambda a, b: a | b, (at(p) for p in range(1, TANDEM_PERIODS + 1)))


def kind(seq: Column | str, backbone: Column | str) -> Column:
    n = length(seq)
    return F.when(_col(backbone), "backbone").when(tandem(seq), "tandem").when(n >= LARGE, "large").when(n <= SMALL, "snp").otherwise("indel")


def preview(seq: Column | str) -> Column:
    s = _col(seq)
    return F.when(F.char_length(s) <= 24, s).otherwise(F.concat(F.left(s, F.lit(12)), F.lit("…"), F.right(s, F.lit(8))))


def chromosome(name: Column | str) -> Column:
    tail = F.substring_index(_col(name), "#", -1)
    return F.substring_index(tail, ":", 1)


def region_start(name: Column | str) -> Column:
    tail = F.substring_index(_col(name), "#", -1)
    rest = F.regexp_extract(tail, "^[^:]*:([^-]*)", 1)
    return F.coalesce(F.when(F.rlike(rest, F.lit(r"^\+?[0-9]+$")), rest.try_cast("long")), F.lit(0).cast("long"))


def sample(name: Column | str) -> Column:
    return F.substring_index(_col(name), "#", 2)


def commas(n: Column | str) -> Column:
    return F.format_number(_col(n), 0)


def significance(text: Column | str) -> Column:
    t = F.lower(_col(text))
    out = F
    for name, pattern, unless in SIGNIFICANCE:
        test = F.rlike(t, F.lit(pattern))
        out = out.when(test & ~F.rlike(t, F.lit(unless)) if unless else test, name)
    return out.otherwise("other")


def query_text(raw: Column | str) -> Column:
    """What a typed query searches for: bases only, null if fewer than two."""
    q = F.regexp_replace(F.upper(F.trim(_col(raw))), "[^ACGTN]", "")
    return F.when(F.char_length(q) >= 2, q)


def zigzag(v: Column | str) -> Column:
    x = _col(v).cast("long")
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def varint_length(v: Column | str) -> Column:
    """Bytes of an unsigned LEB128 number below 2 ** 63."""
    x = _col(v)
    return reduce(lambda a, k: a + (x >= F.lit(1 << (7 * k))).cast("int"), range(1, 9), F.lit(1))


def varint(v: Column | str) -> Column:
    """The unsigned LEB128 bytes of a number from 0 to 2 ** 63 - 1."""
    x = _col(v).cast("long")
    out = []
    for k in range(9):
        low = F.shiftrightunsigned(x, 7 * k).bitwiseAND(F.lit(127))
        more = x >= F.lit(1 << (7 * (k + 1))) if k < 8 else F.lit(False)
        here = x >= F.lit(1 << (7 * k)) if k else F.lit(True)
        out.append(F.when(here, F.lpad(F.hex(F.when(more, low + 128).otherwise(low)), 2, "0")).otherwise(""))
    return F.unhex(F.concat(*out))


def from_varint(data: Column | str) -> Column:
    """The number of one varint's bytes."""
    h = F.hex(_col(data))
    byte = lambda i: F.conv(F.substr(h, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    places = F.sequence(F.lit(0), F.octet_length(_col(data)) - 1)
    return F.aggregate(places, F.lit(0).cast("long"), lambda n, i: n + F.call_function("shiftleft", byte(i).bitwiseAND(F.lit(127)), 7 * i))


def bits_for(n: Column | str) -> Column:
    x = _col(n).cast("long")
    return F.when(x <= 1, 1).otherwise(F.char_length(F.bin(x - 1)))


def effective_order(order: Column, bits: Column) -> Column:
    return F.when(bits == 0, 0).otherwise(F.least(order, F.floor(F.lit(CONTEXT_BITS) / bits).cast("int")))


def twobit_bits(seq: Column | str) -> Column:
    """Two bits a plain base, eight any other byte."""
    plain = length(F.regexp_replace(_col(seq), "[^ACGT]", ""))
    return 2 * plain + 8 * (length(seq) - plain)


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix by halving: one comparison a power of two."""
    n = F.least(F.char_length(a), F.char_length(b))
    steps = F.array(*(F.lit(1 << k) for k in range(27, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda got, k: F.when((got + k <= n) & (F.substr(a, got + 1, k) == F.substr(b, got + 1, k)), got + k).otherwise(got))


def edit_parts(reference: Column, target: Column) -> Column:
    """struct(prefix, suffix, cut, put): the target is the reference's prefix, put, and its suffix; cut bytes are dropped."""
    def parts(p: Column) -> Column:
        rest_r, rest_t = F.substr(reference, p + 1, F.char_length(reference) - p), F.substr(target, p + 1, F.char_length(target) - p)
        s = common_prefix(F.reverse(rest_r), F.reverse(rest_t))
        return F.struct(p.alias("prefix"), s.alias("suffix"))

    def rest(x: Column) -> Column:
        n = F.char_length(target) - x["prefix"] - x["suffix"]
        cut = F.char_length(reference) - x["prefix"] - x["suffix"]
        return F.struct(x["prefix"].alias("prefix"), x["suffix"].alias("suffix"), cut.alias("cut"), F.substr(target, x["prefix"] + 1, n).alias("put"))

    return F.element_at(F.transform(F.transform(F.array(common_prefix(reference, target)), parts), rest), 1)


def edit_script(reference: Column, target: Column) -> Column:
    """Array of (op, len, bases): copy, sub, ins or del, copy."""
    none = F.lit("")

    def script(d: Column) -> Column:
        n = F.char_length(d["put"])
        both = F.least(n, d["cut"])

        def op(name: str, size: Column, bases: Column) -> Column:
            return F.when(size > 0, F.struct(F.lit(name).alias("op"), size.cast("long").alias("len"), bases.alias("bases")))

        return F.array_compact(F.array(
            op("copy", d["prefix"], none), op("sub", both, F.left(d["put"], both)),
            op("ins", n - both, F.substr(d["put"], both + 1, F.greatest(n - both, F.lit(0)))), op("del", d["cut"] - both, none), op("copy", d["suffix"], none),
        ))

    # Bound as a lambda's variable, the parts are found once.
    return F.element_at(F.transform(F.array(edit_parts(reference, target)), script), 1)


def edit_apply(reference: Column, script: Column) -> Column:
    """What a script makes of the reference; copies end where the reference does."""
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        uses = F.when(x["op"].isin("copy", "sub", "del"), x["len"]).otherwise(0)
        put = F.when(x["op"] == "copy", F.substr(reference, (a["at"] + 1).cast("int"), x["len"].cast("int"))).when(x["op"] == "del", "").otherwise(x["bases"])
        return F.struct((a["at"] + uses).alias("at"), F.concat(a["out"], put).alias("out"))

    return F.aggregate(script, nothing, step, lambda a: a["out"])


def register(spark: SparkSession) -> None:
    """Offers the scalar functions to SQL, as SQL functions without Python."""
    fold = f"translate(s, '{LOWER}', '{UPPER}')"
    comp = f"translate(regexp_replace({fold}, '[^{BASES}]', 'N'), '{BASES}', '{COMPLEMENTS}')"
    plain = "octet_length(regexp_replace(s, '[^ACGT]', ''))"
    at = "filter(CASE WHEN q <> '' AND char_length(s) >= char_length(q) THEN sequence(0, char_length(s) - char_length(q)) ELSE cast(array() AS array<int>) END, i -> substr(s, i + 1, char_length(q)) = q)"
    digits = "regexp_extract_all(translate(regexp_replace({0}, '[^TCAG]', 'N'), 'TCAGN', '01234'), '.{{3}}', 0)"
    acids = "array_join(transform({0}, x -> substr('{1}', cast(x AS int) + 1, 1)), '')"
    loose = acids.format(digits.format(f"substr({fold}, frame + 1)"), _amino_table(False))
    strict = acids.format(digits.format("substr(s, frame + 1)"), _amino_table(True))
    classes = " ".join(f"WHEN {' OR '.join(f'a = {x!r}' for x in acids_)} THEN '{name}'" for name, acids_ in AMINO_CLASSES.items())
    tandem = " OR ".join(
        f"(char_length(s) >= {max(4 * p, TANDEM_LEAST)} AND size(filter(sequence({p}, greatest(char_length(s) - 1, {p})), i -> substr(s, i + 1, 1) = substr(s, i - {p} + 1, 1))) / greatest(char_length(s) - {p}, 1) > {TANDEM_SHARE})"
        for p in range(1, TANDEM_PERIODS + 1)
    )
    kinds = f"CASE WHEN backbone THEN 'backbone' WHEN {tandem} THEN 'tandem' WHEN octet_length(s) >= {LARGE} THEN 'large' WHEN octet_length(s) <= {SMALL} THEN 'snp' ELSE 'indel' END"
    rest = "regexp_extract(substring_index(s, '#', -1), '^[^:]*:([^-]*)', 1)"
    significant = " ".join(f"WHEN lower(s) RLIKE '{p}'" + (f" AND NOT lower(s) RLIKE '{no}'" if no else "") + f" THEN '{name}'" for name, p, no in SIGNIFICANCE)
    query = "regexp_replace(upper(trim(s)), '[^ACGTN]', '')"
    for name, args, body in [
        ("seq_upper", "s STRING", fold),
        ("seq_complement", "s STRING", comp),
        ("seq_revcomp", "s STRING", f"reverse({comp})"),
        ("seq_flip", "s STRING", "CASE WHEN s = '-' THEN '+' ELSE '-' END"),
        ("seq_sign", "s STRING", "CASE WHEN s = '' OR left(s, 1) = '+' THEN '+' WHEN left(s, 1) = '-' THEN '-' END"),
        ("seq_translate", "s STRING, frame INT", loose),
        ("seq_translate_strict", "s STRING, frame INT", strict),
        ("seq_codons", "s STRING, frame INT", "regexp_extract_all(substr(s, frame + 1), '(?s).{3}', 0)"),
        ("seq_amino_class", "a STRING", f"CASE {classes} ELSE 'other' END"),
        ("seq_find", "s STRING, q STRING", "CASE WHEN q <> '' AND position(q, s) > 0 THEN cast(position(q, s) - 1 AS bigint) END"),
        ("seq_offsets", "s STRING, q STRING", at),
        ("seq_count", "s STRING, q STRING", f"cast(size({at}) AS bigint)"),
        ("seq_tandem", "s STRING", tandem),
        ("seq_kind", "s STRING, backbone BOOLEAN", kinds),
        ("seq_preview", "s STRING", "CASE WHEN char_length(s) <= 24 THEN s ELSE concat(left(s, 12), '…', right(s, 8)) END"),
        ("seq_chromosome", "s STRING", "substring_index(substring_index(s, '#', -1), ':', 1)"),
        ("seq_region_start", "s STRING", f"coalesce(CASE WHEN {rest} RLIKE '^[+]?[0-9]+$' THEN try_cast({rest} AS bigint) END, 0)"),
        ("seq_sample", "s STRING", "substring_index(s, '#', 2)"),
        ("seq_commas", "n BIGINT", "format_number(n, 0)"),
        ("seq_significance", "s STRING", f"CASE {significant} ELSE 'other' END"),
        ("seq_query_text", "s STRING", f"CASE WHEN char_length({query}) >= 2 THEN {query} END"),
        ("seq_twobit", "s STRING", f"2 * {plain} + 8 * (octet_length(s) - {plain})"),
        ("seq_zigzag", "v BIGINT", "shiftleft(v, 1) ^ shiftright(v, 63)"),
        ("seq_varint_length", "v BIGINT", "1" + "".join(f" + cast(v >= {1 << 7 * k} AS int)" for k in range(1, 9))),
        ("seq_bits_for", "n BIGINT", "CASE WHEN n <= 1 THEN 1 ELSE char_length(bin(n - 1)) END"),
        ("seq_effective_order", "k INT, bits INT", f"CASE WHEN bits = 0 THEN 0 ELSE least(k, {CONTEXT_BITS} div bits) END"),
    ]:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURN {body}")
