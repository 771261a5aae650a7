"""Common table expressions of the oracles, in DuckDB's SQL: the adapters' graphs said once more, from the tables."""

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def up(x: str) -> str:
    return f"translate({x}, '{LOWER}', '{UPPER}')"


def comp(x: str) -> str:
    return f"translate(regexp_replace({up(x)}, '[^ATUGCNRYSWKMBVDH]', 'N', 'g'), 'ATUGCNRYSWKMBVDH', 'TAACGNYRSWMKVBHD')"


def rc(x: str) -> str:
    return f"reverse({comp(x)})"


def place(c: str, i: int) -> str:
    return f"(strpos('TCAG', substr({c}, {i}, 1)) - 1)"


def amino(c: str) -> str:
    return (
        f"CASE WHEN length({c}) <> 3 THEN 'X' WHEN regexp_full_match({c}, '[ACGT]{{3}}') THEN substr('{AMINO}', CAST({place(c, 1)} * 16 + {place(c, 2)} * 4 + {place(c, 3)} + 1 AS INTEGER), 1) "
        f"WHEN substr({c}, 1, 2) IN ('CT', 'GT', 'TC', 'CC', 'AC', 'GC', 'CG', 'GG') THEN substr('{AMINO}', CAST({place(c, 1)} * 16 + {place(c, 2)} * 4 + 1 AS INTEGER), 1) ELSE 'X' END"
    )


def codons(s: str, frame: int) -> str:
    return f"list_transform(range(0, greatest((length({s}) - {frame}) // 3, 0)), lambda i: substr({s}, CAST(i * 3 + {frame + 1} AS INTEGER), 3))"


def twobit(s: str) -> str:
    return f"(2 * strlen(regexp_replace({s}, '[^ACGT]', '', 'g')) + 8 * (strlen({s}) - strlen(regexp_replace({s}, '[^ACGT]', '', 'g'))))"


def offsets(s: str, q: str) -> str:
    return f"list_filter(range(0, greatest(length({s}) - length({q}) + 1, 0)), lambda i: substr({s}, CAST(i + 1 AS INTEGER), length({q})) = {q})"


DNA = f"WITH dna AS (SELECT doc_id, regexp_replace({up('text')}, '[^ACGT]', '', 'g') AS seq FROM documents) "

CORPUS = f"""WITH ln AS (SELECT doc_id AS walk_idx, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS step_idx, unnest(string_split(text, chr(10))) AS line FROM documents),
ids AS (SELECT line, row_number() OVER (ORDER BY line) - 1 AS node_id FROM (SELECT DISTINCT line FROM ln)),
sg AS (SELECT node_id, {up('line')} AS seq, strlen({up('line')}) AS len FROM ids),
st AS (SELECT walk_idx, step_idx, node_id, CASE WHEN step_idx % 3 = 2 THEN '-' ELSE '+' END AS strand FROM ln JOIN ids USING (line)),
nw AS (SELECT walk_idx, count(*) AS n FROM st GROUP BY 1),
bbw AS (SELECT walk_idx FROM nw ORDER BY n DESC, walk_idx LIMIT 1),
wk AS (SELECT doc_id AS walk_idx, source || '#' || doc_id AS name, doc_id IN (SELECT walk_idx FROM bbw) AS is_backbone FROM documents),
bb AS (SELECT * FROM st WHERE walk_idx IN (SELECT walk_idx FROM bbw)) """

ORDERS = """WITH st AS (SELECT l_orderkey AS walk_idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS step_idx, l_partkey AS node_id,
  CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand FROM lineitem),
sg AS (SELECT p_partkey AS node_id, regexp_replace(upper(p_name || p_type || p_brand), '[^ACGT]', '', 'g') AS seq, strlen(regexp_replace(upper(p_name || p_type || p_brand), '[^ACGT]', '', 'g')) AS len FROM part),
nw AS (SELECT walk_idx, count(*) AS n FROM st GROUP BY 1),
bbw AS (SELECT walk_idx FROM nw ORDER BY n DESC, walk_idx LIMIT 1),
wk AS (SELECT walk_idx, 'order#' || walk_idx || '#part:' || (walk_idx * 1000) || '-' || (walk_idx * 1000 + 999) AS name, walk_idx IN (SELECT walk_idx FROM bbw) AS is_backbone FROM nw),
bb AS (SELECT * FROM st WHERE walk_idx IN (SELECT walk_idx FROM bbw)),
off AS (SELECT node_id, min(pl) AS bb_offset FROM (SELECT node_id, coalesce(sum(coalesce(len, 0)) OVER (ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pl FROM bb LEFT JOIN sg USING (node_id)) GROUP BY 1),
prs AS (SELECT * FROM (SELECT walk_idx, step_idx, node_id AS a, strand AS a_strand, lead(node_id) OVER w AS b, lead(strand) OVER w AS b_strand FROM st WINDOW w AS (PARTITION BY walk_idx ORDER BY step_idx)) WHERE b IS NOT NULL),
adj AS (SELECT DISTINCT a, b FROM prs),
ce AS (SELECT a AS from_id, a_strand AS from_strand, b AS to_id, b_strand AS to_strand, min((walk_idx, step_idx)) AS first FROM prs GROUP BY ALL),
ed AS (SELECT row_number() OVER (ORDER BY first) - 1 AS edge_idx, from_id, from_strand, to_id, to_strand FROM ce) """

LAYOUT = "WITH lay AS (SELECT p_partkey AS node_id, p_partkey * 50 AS x, CAST(p_size * 40 AS BIGINT) AS len, p_size % 3 = 0 AS backbone, CAST(p_size % 5 - 2 AS INTEGER) AS lane FROM part) "
