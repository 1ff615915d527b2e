"""Merkle manifest of a dataset: radix-ranked tries over the documents of each source, and one over the sources.

Ranks within a group come from hierarchical digit histograms, not from a sort: rows are counted by the next digit of their
key, prefix sums of the counts give each bucket its first rank, and only buckets that are still too large are counted by a
further digit. Which bits make the next digit is chosen per bucket (the highest in which its keys differ), so runs of shared
digits cost nothing. Buckets small enough for a task are numbered inside. The base-16 digits of a rank are the path of its
leaf in a trie; nodes with one longest proper prefix are the children of one node, so a level is reduced by dropping the last
digit of all paths. Proofs go the other way: a node hands its own path of siblings down to its children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hodoscope.llm.common import cut, send

FANOUT = 16
#: A digit has 8 bits; a bucket of at most so many rows is numbered within one task.
DIGIT_BITS = 8
BUCKET_ROWS = 16_384
#: Source names are told apart by digits of their first 15 * 7 bytes; more sources than BUCKET_ROWS that agree in them are still numbered, in one task.
NAME_CHUNKS = 15


def _unsigned(c: Column) -> Column:
    """The long whose signed order is c's unsigned order, and the other way round."""
    return c.bitwiseXOR(F.lit(-(2**63)))


def radix_rank(rows: DataFrame, group: str, parts: list[Column], order: list[Column], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows with rank, from 0 within each value of group (null is a value).

    parts: the key, longs that count as unsigned numbers; order: columns that sort as the whole key does. rows should be a
    written table, for each level of digits reads it again. A histogram has at most 256 rows for each bucket that is above
    bucket_rows; rows of one bucket whose parts all agree are numbered by order in one task, so the last part should be the
    row's own number.
    """
    keys = ["r_group", "r_base"]

    def measures() -> list[Column]:
        return [F.count("*").alias("n"), *(f(_unsigned(p)).alias(f"r_{s}{i}") for i, p in enumerate(parts) for s, f in (("lo", F.min), ("hi", F.max)))]

    def still_open(hist: DataFrame) -> DataFrame:
        """Buckets to be dealt out: by which part, and by which of its bits."""
        differ = [F.col(f"r_lo{i}").bitwiseXOR(F.col(f"r_hi{i}")) for i in range(len(parts))]
        at = F.coalesce(*(F.when(d != 0, F.struct(F.lit(i).alias("part"), F.greatest(F.length(F.bin(d)) - DIGIT_BITS, F.lit(0)).alias("shift"))) for i, d in enumerate(differ)))
        return hist.where(F.col("n") > bucket_rows).select(F.col("r_group").alias("o_group"), F.col("r_base").alias("o_base"), at.alias("r_at")).where("r_at IS NOT NULL")

    state = rows.withColumns({"r_group": F.col(group), "r_base": F.lit(0).cast("long")})
    todo = cut(still_open(state.groupBy(*keys).agg(*measures())), "open")
    while count := todo.count():
        own = F.coalesce(*(F.when(F.col("r_at.part") == i, p) for i, p in enumerate(parts)))
        joined = state.join(send(todo, count), F.col("r_group").eqNullSafe(F.col("o_group")) & (F.col("r_base") == F.col("o_base")), "left").withColumn("r_own", own)
        joined = joined.withColumn("r_digit", F.expr("shiftrightunsigned(r_own, r_at.shift)").bitwiseAND(2**DIGIT_BITS - 1)).drop("o_group", "o_base", "r_at", "r_own")
        hist = joined.where("r_digit IS NOT NULL").groupBy(*keys, "r_digit").agg(*measures())
        first = F.col("r_base") + F.sum("n").over(Window.partitionBy(*keys).orderBy("r_digit")) - F.col("n")
        hist = cut(hist.withColumn("first", first), "histogram")
        to = hist.select(F.col("r_group").alias("h_group"), F.col("r_base").alias("h_base"), F.col("r_digit").alias("h_digit"), "first")
        meet = F.col("r_group").eqNullSafe(F.col("h_group")) & (F.col("r_base") == F.col("h_base")) & (F.col("r_digit") == F.col("h_digit"))
        state = joined.join(send(to, to.count()), meet, "left").withColumn("r_base", F.coalesce("first", "r_base")).select(*rows.columns, *keys)
        todo = cut(still_open(hist.withColumn("r_base", F.col("first"))), "open")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return state.withColumn("rank", F.col("r_base") + inside - 1).drop(*keys)


def digest(binary: Column) -> Column:
    """H of digests put together: their hexadecimal text is hashed."""
    return F.unhex(F.sha2(F.lower(F.hex(binary)), 256))


def fields_digest(columns: list[Column]) -> Column:
    """H of a row: `-` for a null, else the value's UTF-8 byte count, a colon and the value."""
    text = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256))


def build(leaves: DataFrame) -> list[DataFrame]:
    """The levels of the tries over leaves(g, n, rank, h, item): each (g, pos, left, h, kids).

    n: leaves of g. The first level holds runs of up to 16 leaves and their items; left is the number of nodes of g on a
    level, and a node with left = 1 is the top of its group: of a lone leaf, that leaf itself. kids: the children's digests.
    """
    first = leaves.groupBy("g", "n", F.expr(f"rank div {FANOUT}").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("rank", "h", "item"))).alias("run"))
    kids = F.expr("aggregate(run, X'', (a, x) -> concat(a, x.h))")
    first = first.withColumn("kids", kids).select(
        "g", "pos", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("left"), F.when(F.col("n") == 1, F.col("kids")).otherwise(digest(F.col("kids"))).alias("h"), (F.col("n") == 1).alias("lone"), "kids", F.expr("transform(run, x -> x.item)").alias("items")
    )
    levels = [cut(first, "runs")]
    while (levels[-1].agg(F.max("left")).first()[0] or 0) > 1:
        below = levels[-1].where("left > 1").groupBy("g", "left", F.expr(f"pos div {FANOUT}").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("run"))
        below = below.withColumn("kids", kids)
        levels.append(cut(below.select("g", "pos", F.expr(f"(left + {FANOUT - 1}) div {FANOUT}").alias("left"), digest(F.col("kids")).alias("h"), F.lit(False).alias("lone"), "kids"), "nodes"))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(g, h): what remains of each group."""
    out = None
    for level in levels:
        part = level.where("left = 1").select("g", "h")
        out = part if out is None else out.unionByName(part)
    return out


def unfold(levels: list[DataFrame], above: DataFrame, groups: int) -> DataFrame:
    """The leaves with their paths upwards: (g, rank, h, item, path, and the further columns of above).

    above(g, path, ...): the path of each group's top, and what its leaves are to carry; groups: its rows. A path has one
    (l, r) for each step: the digests of the siblings to the left and to the right.
    """
    carried = [c for c in above.columns if c not in ("g", "path")]
    tops_at = above.select(F.col("g").alias("a_g"), F.col("path"), *carried)
    handed = None
    for i in reversed(range(len(levels))):
        level = levels[i]
        nodes = level.where("left = 1").join(send(tops_at, groups), F.col("g").eqNullSafe(F.col("a_g"))).drop("a_g")
        if handed is not None:
            rest = level.where("left > 1").join(handed, level["g"].eqNullSafe(handed["h_g"]) & (level["pos"] == handed["h_pos"])).drop("h_g", "h_pos")
            nodes = nodes.unionByName(rest)
        step = F.struct(F.expr("substring(kids, 1, 32 * at)").alias("l"), F.expr("substring(kids, 32 * at + 33)").alias("r"))
        kid = nodes.withColumn("at", F.explode(F.sequence(F.lit(0), F.expr("int(length(kids) / 32) - 1"))))
        path = F.when(F.col("lone"), F.col("path")).otherwise(F.concat(F.array(step), F.col("path"))).alias("path")
        pos = F.expr(f"pos * {FANOUT} + at")
        if i:
            handed = kid.select(F.col("g").alias("h_g"), pos.alias("h_pos"), path, *carried)
        else:
            return kid.select("g", pos.alias("rank"), F.expr("substring(kids, 32 * at + 1, 32)").alias("h"), F.expr("items[at]").alias("item"), path, *carried)


_NO_PATH = "cast(array() AS array<struct<l: binary, r: binary>>)"


def proof_digest(path: Column) -> Column:
    return F.sha2(F.lower(F.hex(F.aggregate(path, F.expr("X''"), lambda a, s: F.concat(a, s["l"], s["r"])))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda a, s: digest(F.concat(s["l"], a, s["r"])))


def _name_parts(name: str) -> list[Column]:
    """A string's UTF-8 bytes as unsigned numbers: 7 bytes and, below them, how many of them are there."""
    out = [F.col(name).isNotNull().cast("long")]
    for c in range(NAME_CHUNKS):
        piece = F.expr(f"coalesce(substring(cast({name} AS binary), {7 * c + 1}, 7), X'')")
        out.append(F.shiftleft(F.conv(F.rpad(F.hex(piece), 14, "0"), 16, 10).cast("long"), 8).bitwiseOR(F.length(piece).cast("long")))
    return out


def manifest(docs: DataFrame, fields: list[str], check: dict[str, Column] | None = None, chosen: Column | None = None, id_col: str = "doc_id", group: str = "source", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of docs: its leaf, its source's subroot, the root, its proof, and the root folded from `check`.

    check: columns that replace fields of the rows that are `chosen` before they are folded again; without it, each row folds
    its own leaf. Returns id_col, group, rank, leaf, subroot, root, path (array of l, r: the siblings' digests), folded_root
    (digests as bytes). Leaves ascend by id (null first), then leaf; rows that agree in both are told apart by their place in
    the table, and either order gives the same rows. An empty table gives no rows. Extra columns are not read.
    """
    other = F.when(chosen, fields_digest([(check or {}).get(f, F.col(f)) for f in fields])) if chosen is not None else F.lit(None).cast("binary")
    base = cut(docs.select(F.col(id_col).alias("id"), F.col(group).alias("g"), fields_digest([F.col(f) for f in fields]).alias("h"), other.alias("other"), F.monotonically_increasing_id().alias("row")), "leaves")
    parts = [F.col("id").isNotNull().cast("long"), _unsigned(F.coalesce("id", F.lit(0)).cast("long")), F.conv(F.substring(F.hex("h"), 1, 16), 16, -10).cast("long"), F.col("row")]
    sizes = cut(base.groupBy("g").agg(F.count("*").alias("n")).withColumnRenamed("g", "s_g"), "sizes")
    groups = sizes.count()
    ranked = radix_rank(base, "g", parts, [F.asc_nulls_first("id"), F.asc("h"), F.asc("row")], bucket_rows)
    ranked = ranked.join(send(sizes, groups), F.col("g").eqNullSafe(F.col("s_g"))).select("g", "n", "rank", "h", F.struct("id", "other").alias("item"))
    levels = build(ranked)
    subroots = cut(tops(levels).select(F.lit(0).alias("g"), F.col("g").alias("name"), "h"), "subroots")
    named = radix_rank(subroots, "g", _name_parts("name"), [F.expr("name IS NOT NULL"), F.expr("cast(name AS binary)")], bucket_rows)
    upper = build(named.select("g", F.lit(groups).cast("long").alias("n"), "rank", "h", F.col("name").alias("item")))
    root = tops(upper).select("g", F.expr(_NO_PATH).alias("path"), F.col("h").alias("root"))
    above = cut(unfold(upper, root, 1).select(F.col("item").alias("g"), "path", F.col("h").alias("subroot"), "root"), "above")
    out = unfold(levels, above, groups)
    return out.select(F.col("item.id").alias(id_col), F.col("g").alias(group), "rank", F.col("h").alias("leaf"), "subroot", "root", "path", folded(F.coalesce("item.other", "h"), F.col("path")).alias("folded_root"))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of documents; where 5 divides crc32(doc_id), the text's A-Z were lower-cased behind the manifest's back.

    Nulls: a null field counts as `-`, a null source is a source of its own, a null doc_id ranks first and isn't tampered with.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    low = F.translate("text", LETTERS, LETTERS.lower())
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    m = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], {"text": low}, hit)
    text = {c: F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "folded_root")}
    return m.select(
        "doc_id", text["leaf"], text["subroot"], text["root"], proof_digest(F.col("path")).alias("proof_sha256"), text["folded_root"], (F.col("folded_root") == F.col("root")).alias("verified"), "source", "rank"
    )


def _levels_sql(name: str, leaves: str, deepest: int = 12) -> str:
    """CTEs <name>0 .. and <name>_all(lvl, g, pos, left, h): the levels of one trie, nodes with left = 1 going no further."""
    out = [f"{name}0 AS MATERIALIZED ({leaves})"]
    for i in range(1, deepest):
        out.append(
            f"{name}{i} AS MATERIALIZED (SELECT g, pos // {FANOUT} AS pos, (\"left\" + {FANOUT - 1}) // {FANOUT} AS \"left\", sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}{i - 1} WHERE \"left\" > 1 GROUP BY g, pos // {FANOUT}, \"left\")"
        )
    every = " UNION ALL ".join(f'SELECT {i} AS lvl, g, pos, "left", h FROM {name}{i}' for i in range(deepest))
    return ",\n".join([*out, f"{name}_all AS MATERIALIZED ({every})"])


def _siblings_sql(name: str, out: str, deepest: int = 12) -> str:
    """CTE <out>(g, pos, lvl, l, r): for each leaf and level the siblings to its left and right."""
    return f"""{out} AS MATERIALIZED (
  SELECT a.g, a.pos, s.lvl,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < a.pos // ({FANOUT} ** s.lvl)::BIGINT), '') AS l,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > a.pos // ({FANOUT} ** s.lvl)::BIGINT), '') AS r
  FROM {name}0 a JOIN {name}_all s ON a.g IS NOT DISTINCT FROM s.g AND s."left" > 1 AND s.pos // {FANOUT} = a.pos // ({FANOUT} ** (s.lvl + 1))::BIGINT
  GROUP BY a.g, a.pos, s.lvl)"""


def _field_sql(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_STEPS = "list_concat([4294967295], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1)) + 4294967296, 0, 0, 0, 0, 0, 0, 0, 0])))"
_CRC = f"xor(list_reduce({_STEPS}, lambda a, b: CASE WHEN b > 0 THEN xor(a, b - 4294967296) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"

ORACLE = f"""
WITH d AS (
  SELECT doc_id, source AS g, {_leaf_sql("text")} AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {_leaf_sql("text")}) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN {_leaf_sql(f"translate(text, '{LETTERS}', '{LETTERS.lower()}')")} ELSE {_leaf_sql("text")} END AS other
  FROM documents),
{_levels_sql("t", 'SELECT g, pos, n AS "left", h FROM d')},
{_siblings_sql("t", "ts")},
sub AS MATERIALIZED (SELECT g AS name, h, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS pos FROM t_all WHERE "left" = 1),
{_levels_sql("u", 'SELECT 0 AS g, pos, (SELECT count(*) FROM sub) AS "left", h FROM sub', 6)},
{_siblings_sql("u", "us", 6)},
steps AS MATERIALIZED (
  SELECT g, pos, lvl, l, r FROM ts
  UNION ALL SELECT d.g, d.pos, 100 + us.lvl, us.l, us.r FROM d JOIN sub ON d.g IS NOT DISTINCT FROM sub.name JOIN us ON us.pos = sub.pos),
p AS MATERIALIZED (
  SELECT g, pos, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof, list(l || '|' || r ORDER BY lvl) AS path FROM steps GROUP BY g, pos),
f AS (
  SELECT d.doc_id, d.h AS leaf, sub.h AS subroot, (SELECT h FROM u_all WHERE "left" = 1) AS root, coalesce(p.proof, sha256('')) AS proof_sha256, d.g AS source, d.pos AS rank,
    list_reduce(list_concat([d.other], coalesce(p.path, [])), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM d JOIN sub ON d.g IS NOT DISTINCT FROM sub.name LEFT JOIN p ON d.g IS NOT DISTINCT FROM p.g AND d.pos = p.pos)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified, source, rank FROM f
"""
