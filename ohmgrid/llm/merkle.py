"""Merkle manifest of a table: a digest of every row, a root of every group and one root of all.

Leaves are numbered along (group, key) in sorted ranges and gathered into ordered
arrays of a fixed size.  Built-in higher-order functions collapse each array level
by level to its root and cut the siblings of every leaf; the block roots are the
leaves of the next, much smaller round, until each group is one block.  The group
roots are a last tree of the same kind.  Paths are handed down block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.functions.storage import small_side
from ohmgrid.llm.common import durable
from ohmgrid.operators import ranges

ARITY = 2
#: Levels that one array collapses; it has arity ** DEPTH leaves.
DEPTH = 9
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One level of a path: the digests of the run before and after one's own, joined.
STEP = "struct<before:string,after:string>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row's values in order: ``-`` for a null, else the bytes of the value as text, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda own, step: digest(F.concat(step["before"], own, step["after"])))


def path_digest(path: Column) -> Column:
    """Digest of the siblings of a path, level by level."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""))


def _levels_needed(n: Column, arity: int, depth: int) -> Column:
    """Levels that a block collapses: all ``depth`` of them in a group of several blocks, else until one node is left."""
    out = F.lit(depth)
    for k in reversed(range(depth)):
        out = F.when(n <= arity**k, k).otherwise(out)
    return out


def _runs(length: Column, arity: int) -> Column:
    """Starts, from 1, of runs of ``arity`` of an array of at least one."""
    return F.sequence(F.lit(1), length, F.lit(arity))


def blocks(nodes: DataFrame, arity: int, depth: int) -> DataFrame:
    """(grp, block, n, members, levels): the trees over arrays of arity ** depth nodes of (grp, pos, n, digest, member).

    ``levels`` holds the digests of every level from the leaves to the block's root.
    """
    size = arity**depth
    at = F.struct(F.col("pos"), F.col("digest"), F.col("member"))
    held = nodes.groupBy("grp", F.expr(f"pos div {size}").alias("block"), "n").agg(F.sort_array(F.collect_list(at)).alias("z"))
    leaves = F.transform("z", lambda x: x["digest"])

    def up(levels: Column, _: Column) -> Column:
        def above(below: Column) -> Column:
            return F.transform(_runs(F.size(below), arity), lambda k: digest(F.array_join(F.slice(below, k, F.lit(arity)), "")))

        return F.concat(levels, F.transform(F.slice(levels, F.lit(-1), F.lit(1)), above))

    steps = F.sequence(F.lit(0), _levels_needed(F.col("n"), arity, depth))
    trees = F.aggregate(F.slice(steps, F.lit(2), F.lit(depth)), F.array(leaves), up)
    return held.select("grp", "block", "n", F.transform("z", lambda x: x["member"]).alias("members"), trees.alias("levels"))


def _own_path(levels: Column, at: Column, arity: int) -> Column:
    """The siblings of leaf ``at`` (from 0) below the root of its block."""

    def step(level: Column, k: Column) -> Column:
        place = F.floor(at / F.pow(F.lit(float(arity)), k)).cast("int")
        first = place - place % arity
        before = F.array_join(F.slice(level, first + 1, place - first), "")
        after = F.array_join(F.slice(level, place + 2, F.lit(arity - 1) - (place - first)), "")
        return F.struct(before.alias("before"), after.alias("after"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def trees(nodes: DataFrame, arity: int, depth: int) -> DataFrame:
    """(grp, member, digest, root, path) of nodes (grp, pos, n, digest, member), the positions from 0 to n - 1 in each group."""
    rounds, size = [], arity**depth
    while True:
        rounds.append(durable(blocks(nodes, arity, depth)))
        roots = rounds[-1].select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("digest"))
        if not roots.where("n > 1").limit(1).count():
            break
        nodes = roots.withColumn("member", F.lit(None).cast("string"))
    above = roots.select("grp", F.col("pos").alias("block"), F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    for lower in reversed(rounds):
        upper = above.select(F.col("grp").alias("grp_above"), F.col("block").alias("block_above"), "root", F.col("path").alias("path_above"))
        met = F.col("grp").eqNullSafe(F.col("grp_above")) & (F.col("block") == F.col("block_above"))

        def one(member: Column, k: Column) -> Column:
            path = F.concat(_own_path(F.col("levels"), k, arity), F.col("path_above"))
            return F.struct(member.alias("member"), F.get(F.element_at("levels", 1), k).alias("digest"), path.alias("path"), k.alias("k"))

        opened = lower.join(upper, met).select("grp", "block", "root", F.inline(F.transform("members", one)))
        above = opened.select("grp", "member", "digest", "root", "path", (F.col("block") * size + F.col("k")).alias("block"))
    return above.select("grp", "member", "digest", "root", "path")


def manifest(
    documents: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group: str = "lang",
    key: str = "doc_id",
    carry: dict[str, Column] | None = None,
    arity: int = ARITY,
    depth: int = DEPTH,
) -> DataFrame:
    """One row per row: key, the ``carry`` columns, group, leaf, subroot, root and path.

    ``leaf`` is the digest of ``fields``; leaves ascend by key in each group, and while
    several nodes remain every ``arity`` consecutive ones become the digest of their
    digests; a lone leaf is its group's ``subroot``.  Subroots, ordered by group, give
    ``root`` alike.  ``path`` holds the siblings from the leaf to the root, so that
    ``fold(leaf, path)`` is the root.  Nulls: a null value is a ``-``, a null group is a
    group of its own and the first, a null key comes before all others.  Repeated keys are ordered by
    leaf, and equal rows have leaves of their own.  An empty table gives no rows.
    Texts of any length are digested whole.  Other columns, whatever their names, are ignored.
    """
    if arity < 2 or depth < 1:
        raise ValueError("arity must be at least 2 and depth at least 1")
    carry = carry or {}
    own = F.struct(F.col(f"`{key}`").alias("key"), *[c.alias(f"c{k}") for k, c in enumerate(carry.values())])
    leaves = documents.select(F.col(f"`{group}`").cast("string").alias("grp"), own.alias("member"), leaf_digest([F.col(f"`{f}`") for f in fields]).alias("digest"))
    # Stored with a number, by which rows that are wholly equal are dealt out too.
    leaves = durable(leaves.withColumn("row", F.monotonically_increasing_id()))
    order = [F.col("member.key").asc_nulls_first(), F.col("digest"), F.col("row")]
    below = trees(ranges.numbered(leaves, ["grp"], order, "pos", "n").select("grp", "pos", "n", "digest", "member"), arity, depth)
    below = durable(below)
    subroots = below.groupBy("grp").agg(F.first("root").alias("digest")).select(F.col("grp").alias("member"), "digest")
    named = ranges.numbered(durable(subroots), [], [F.col("member").asc_nulls_first()], "pos", "n")
    above = trees(named.select(F.lit(0).alias("grp"), "pos", "n", "digest", "member"), arity, depth)
    top = small_side(durable(above.select(F.col("member").alias("of"), F.col("root").alias("top"), F.col("path").alias("rest"))))
    met = below.join(top, F.col("grp").eqNullSafe(F.col("of")))
    kept = [F.col(f"member.c{k}").alias(name) for k, name in enumerate(carry)]
    path = F.concat("path", "rest").alias("path")
    return met.select(F.col("member.key").alias(key), *kept, F.col("grp").alias(group), F.col("digest").alias("leaf"), F.col("root").alias("subroot"), F.col("top").alias("root"), path)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``, and what rows with a changed ``n_chars`` are found to be: 7 divides the crc32 of their id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    n_chars = F.when(changed, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    present = leaf_digest([n_chars if f == "n_chars" else F.col(f) for f in FIELDS])
    rows = manifest(docs, carry={"present": present})
    folded = fold(F.col("present"), F.col("path"))
    out = rows.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# A crc32 by single bits, the lowest of each byte first; trees by recursion, one level a step.
ORACLE_SQL = """
WITH RECURSIVE ids AS (
  SELECT doc_id, source, lang, n_chars, text, CAST(doc_id AS VARCHAR) AS name FROM documents
), bits AS (
  SELECT *, list_reduce(flatten([[CAST((ascii(name[k]) >> CAST(b AS INTEGER)) & 1 AS BIGINT) FOR b IN range(8)] FOR k IN range(1, len(name) + 1)]),
    lambda c, x: xor(c >> 1, CAST(3988292384 AS BIGINT) * (xor(c, x) & 1)), CAST(4294967295 AS BIGINT)) AS c FROM ids
), changed AS (
  SELECT doc_id, source, lang, n_chars, text, coalesce(xor(c, CAST(4294967295 AS BIGINT)) % 7 = 0, false) AS other FROM bits
), fields AS (
  SELECT doc_id, lang,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS own,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS next, other,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM changed
), leaves AS (
  SELECT doc_id, lang, sha256(head || own || tail) AS leaf, sha256(head || CASE WHEN other THEN next ELSE own END || tail) AS present FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp,
    count(*) OVER (PARTITION BY lang) AS n FROM leaves
), levels AS (
  SELECT grp, 0 AS level, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT grp, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM levels WHERE n > 1 GROUP BY grp, level, pos // 2, n
), subroots AS (SELECT grp, h FROM levels WHERE n = 1
), tops AS (
  SELECT 0 AS level, grp AS pos, (SELECT count(*) FROM subroots) AS n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n
), walk AS (
  SELECT doc_id, grp, leaf, present, pos, 0 AS level, n, false AS top, present AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT w.doc_id, w.grp, w.leaf, w.present,
    CASE WHEN w.n = 1 AND NOT w.top THEN w.grp ELSE w.pos // 2 END, CASE WHEN w.n = 1 AND NOT w.top THEN 0 ELSE w.level + 1 END,
    CASE WHEN w.n = 1 AND NOT w.top THEN (SELECT count(*) FROM subroots) ELSE (w.n + 1) // 2 END, w.top OR w.n = 1,
    CASE WHEN w.n = 1 AND NOT w.top THEN w.folded WHEN w.pos % 2 = 0 THEN sha256(w.folded || coalesce(s.h, t.h, '')) ELSE sha256(coalesce(s.h, t.h, '') || w.folded) END,
    w.proof || CASE WHEN w.n = 1 AND NOT w.top THEN '' ELSE coalesce(s.h, t.h, '') END
  FROM walk w
  LEFT JOIN levels s ON NOT w.top AND s.grp = w.grp AND s.level = w.level AND s.pos = xor(w.pos, 1) AND w.n > 1
  LEFT JOIN tops t ON w.top AND t.level = w.level AND t.pos = xor(w.pos, 1) AND w.n > 1
  WHERE NOT (w.top AND w.n = 1)
)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
FROM walk w JOIN subroots s ON s.grp = w.grp CROSS JOIN (SELECT h FROM tops WHERE n = 1) r WHERE w.top AND w.n = 1
"""
