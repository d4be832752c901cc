"""A Merkle manifest of a table: one tree for each source, and one over the sources' roots.

Every row is a leaf. A source's leaves stand in order of their ids; sixteen neighbours at a time become
their hash, level by level, until one node is left, and the sources' nodes become the root likewise.

256 neighbours, an aligned block, are worked on as strings of digests laid end to end: a level
is one string of at most 16 KB, fixed-width pieces of it hash to the level above, and what lies left and
right of a digest in its piece are its siblings. A block is so reduced to one node two levels up, and these
nodes go through the same step, in tables that shrink by 256 a time. The nodes' own siblings come back down
a block at a time, so that siblings are joined to blocks, never to rows.

The place of a leaf in its source comes from one range sort and sums over partitions: a source that holds a
third of all rows is dealt over a third of the tasks. Only ids and digests are shuffled, no texts.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

FAN_OUT, DIGEST = 16, 64
#: Characters of a run of siblings, and leaves of a block.
RUN, WIDTH = FAN_OUT * DIGEST, FAN_OUT * FAN_OUT
#: The columns that make a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SEGMENTS = "array<struct<left:string,right:string>>"


def hash_of(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts laid end to end."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(*values: Column) -> Column:
    """A row's digest: each value ``-`` if null, else its length in bytes, ``:`` and itself; numbers in decimals."""
    texts = [v.cast("string") for v in values]
    return hash_of(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fold(leaf: Column, segments: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(segments, leaf, lambda node, s: hash_of(s["left"], node, s["right"]))


def siblings(segments: Column) -> Column:
    """All siblings of a path laid end to end, level by level, left to right."""
    return F.array_join(F.transform(segments, lambda s: F.concat(s["left"], s["right"])), "")


def _numbered(nodes: DataFrame, group: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with ``pos``, the row's number in its group from 0 in the given order, and ``n``, the group's size.

    Rows are sorted by range, each partition numbers its own, and a group's offset in a partition is the
    sum of its rows in those before: a window over (partition, group), at most one row for each of these.
    The second table returned is what was written; it can go when the first has been.
    """
    ranged = nodes.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    mono = F.monotonically_increasing_id()
    placed = materialize(ranged.withColumns({"part": F.shiftright(mono, 33), "at": mono.bitwiseAND((1 << 33) - 1)}), "merkle-placed")
    counts = placed.groupBy("part", *group).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    within = Window.partitionBy(*group)
    before = F.coalesce(F.sum("rows").over(within.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumns({"n": F.sum("rows").over(within), "shift": before - F.col("first")}).drop("rows", "first")
    return placed.join(offsets, ["part", *group]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift"), placed


def _parents(level: Column) -> Column:
    """The level above: each run of sixteen digests becomes its hash."""
    starts = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(starts, lambda i: F.sha2(F.substring(level, i * RUN + 1, F.lit(RUN)), 256)), "")


def _flanks(level: str, at: Column) -> Column:
    """What lies left and right of the digest number ``at`` of a level, in its run of sixteen."""
    run = F.substring(F.col(level), F.floor(at / FAN_OUT).cast("int") * RUN + 1, F.lit(RUN))
    own = (at % FAN_OUT).cast("int") * DIGEST
    return F.struct(F.substring(run, F.lit(1), own).alias("left"), F.substring(run, own + 1 + DIGEST, F.lit(RUN)).alias("right"))


def _climb(nodes: DataFrame, group: Sequence[str], keep: Sequence[str]) -> list[tuple[DataFrame, DataFrame]]:
    """The blocks of ``nodes`` (group, keep, pos, n, node), those of the nodes two levels up, and so on to one node a group.

    For each step (blocks, tops): a block has its entries and two levels as strings, ``l0`` and ``l1``; a top
    is a block's node, and ``one`` where it is its group's only one.
    """
    steps = []
    while True:
        entry = F.struct((F.col("pos") % WIDTH).cast("int").alias("at"), "node", *keep)
        blocks = nodes.groupBy(*group, F.floor(F.col("pos") / WIDTH).alias("block"), "n").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        blocks = blocks.withColumn("l0", F.array_join("entries.node", ""))
        blocks = materialize(blocks.withColumn("l1", F.when(F.col("n") > 1, _parents(F.col("l0")))), "merkle-blocks")
        node = F.when(F.col("n") > FAN_OUT, _parents(F.col("l1"))).otherwise(F.coalesce("l1", "l0"))
        tops = blocks.select(*group, F.col("block").alias("pos"), F.ceil(F.col("n") / WIDTH).alias("n"), node.alias("node"), (F.col("n") <= WIDTH).alias("one"))
        tops = materialize(tops, "merkle-tops")
        steps.append((blocks, tops))
        nodes, keep = tops.filter("not one").drop("one"), []
        if nodes.isEmpty():
            return steps


def _descend(steps: list[tuple[DataFrame, DataFrame]], group: Sequence[str], keep: Sequence[str], ends: DataFrame, told: Sequence[str]) -> DataFrame:
    """(group, keep, pos, node, told, segments) of every node, from ``ends`` (group, told, segments) of the groups' roots.

    ``told`` is handed down unchanged; a node's siblings stand before those of its block's node.
    """
    own, below = F.col("e.at"), None
    first, second = _flanks("l0", own), _flanks("l1", F.floor(own / FAN_OUT))
    lower = F.when(F.col("n") > FAN_OUT, F.array(first, second)).when(F.col("n") > 1, F.array(first)).otherwise(F.array().cast(_SEGMENTS))
    for depth, (blocks, tops) in reversed(list(enumerate(steps))):
        known = tops.filter("one").select(*group, F.col("pos").alias("block")).join(ends, group)
        if below is not None:
            known = known.unionByName(below.select(*group, F.col("pos").alias("block"), *told, "segments"))
        if depth < len(steps) - 1:
            known = materialize(known, "merkle-known")
        kept = keep if depth == 0 else []
        spread = blocks.join(known, [*group, "block"]).select(*group, "n", "block", "l0", "l1", *told, "segments", F.explode("entries").alias("e"))
        below = spread.select(
            *group, *[f"e.{c}" for c in kept], (F.col("block") * WIDTH + own).alias("pos"), "e.node", *told, F.concat(lower, "segments").alias("segments")
        )
    return below


def merkle_manifest(
    docs: DataFrame,
    carry: Sequence[Column | str] = ("doc_id",),
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """The manifest of a table, with the path of every row.

    Returns one row per input row: ``row`` (a struct of the ``carry`` columns), ``leaf``, ``pos`` (the leaf's number
    in its source, from 0), ``subroot``, ``root`` and ``segments``, the path's siblings from the leaf's level to
    the root's: an array of (left, right), each digests laid end to end. ``fold`` and ``siblings`` read it.

    Leaves stand by id, null ids first, rows of one id by digest; rows that agree in both are alike and stand in
    any order, so the result is the same on every run. A null source is a source of its own and the first; nulls in
    ``fields`` have their own mark; a text of any length is hashed where it lies. A source with one row, and a
    table with one source, add no level. An empty table gives an empty result. ``carry`` rides along in the sort, so
    it should be small; further columns are not read, whatever their names.
    """
    by = ["named", "src"]
    leaves = docs.select(
        F.struct(*carry).alias("row"), F.col(source_col).isNotNull().alias("named"), F.coalesce(F.col(source_col), F.lit("")).alias("src"),
        F.col(id_col).alias("id"), leaf_of(*[F.col(f) for f in fields]).alias("node"), F.monotonically_increasing_id().alias("uid"),
    )
    # Written once: the sort draws a sample first, which would hash every text twice. ``uid`` parts rows that agree.
    leaves = materialize(leaves, "merkle-leaves")
    numbered, placed = _numbered(leaves, by, ["id", "node", "uid"])
    steps = _climb(numbered, by, ["row"])
    discard(leaves, placed)

    # The sources' roots are the nodes of one tree more; there may be as many as rows, so they are numbered likewise.
    heads = reduce(DataFrame.unionByName, [tops.filter("one").select(*by, "node") for _, tops in steps])
    every, placed = _numbered(heads.withColumn("all", F.lit(0)), ["all"], by)
    over = _climb(every, ["all"], by)
    discard(placed)
    root = over[-1][1].select("all", F.col("node").alias("root"), F.array().cast(_SEGMENTS).alias("segments"))
    ends = materialize(_descend(over, ["all"], by, root, ["root"]).select(*by, F.col("node").alias("subroot"), "root", "segments"), "merkle-sources")
    found = _descend(steps, by, ["row"], ends, ["subroot", "root"])
    return found.select("row", F.col("node").alias("leaf"), "pos", "subroot", "root", "segments")


def tampered(doc_id: Column, text: Column) -> Column:
    """The text after tampering: where five divides the CRC-32 of the id in decimals, A to Z become lower case."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(text)


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """The manifest of the whole of ``documents``, every path folded again from the row as it is after tampering."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = leaf_of(*[tampered(F.col("doc_id"), F.col("text")) if f == "text" else F.col(f) for f in FIELDS])
    found = merkle_manifest(docs, carry=["doc_id", now.alias("now")])
    return found.select(
        "row.doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("segments")), 256).alias("proof_sha256"), fold(F.col("row.now"), F.col("segments")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = r"""
WITH RECURSIVE crc_step(doc_id, rest, v) AS (
  SELECT doc_id, doc_id::VARCHAR, 4294967295::BIGINT FROM documents
  UNION ALL
  SELECT doc_id, rest[2:], list_reduce(list_prepend(xor(v, ascii(rest)::BIGINT), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
  FROM crc_step WHERE rest <> ''
), crc AS (SELECT doc_id, xor(v, 4294967295) AS v FROM crc_step WHERE rest = ''
), d AS (
  SELECT doc_id, source,
         concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                   coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         coalesce(strlen(text) || ':' || text, '-') AS kept,
         CASE WHEN crc.v % 5 = 0 THEN coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') ELSE coalesce(strlen(text) || ':' || text, '-') END AS now
  FROM documents JOIN crc USING (doc_id)
), leaf AS (
  SELECT doc_id, source, sha256(head || kept) AS leaf, sha256(head || now) AS now, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d
), t(level, source, pos, n, h) AS (
  SELECT 0, source, pos, n, leaf FROM leaf
  UNION ALL
  SELECT level + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY level, source, pos // 16, n
), sub AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1
), u(level, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM sub
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 16, n
), runs AS (
  SELECT 0 AS tree, level, source, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM t WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT 1, level, NULL, pos // 16, list(h ORDER BY pos) FROM u WHERE n > 1 GROUP BY ALL
), f(doc_id, source, tree, level, pos, n, node, proof) AS (
  SELECT doc_id, source, 0, 0, pos, n, now, '' FROM leaf
  UNION ALL
  (SELECT f.doc_id, f.source, f.tree, f.level + 1, f.pos // 16, (f.n + 15) // 16,
          sha256(array_to_string(hs[1:f.pos % 16], '') || node || array_to_string(hs[f.pos % 16 + 2:], '')),
          proof || array_to_string(hs[1:f.pos % 16], '') || array_to_string(hs[f.pos % 16 + 2:], '')
   FROM f JOIN runs r ON r.tree = f.tree AND r.level = f.level AND r.run = f.pos // 16 AND (f.tree = 1 OR r.source IS NOT DISTINCT FROM f.source) WHERE f.n > 1
   UNION ALL
   SELECT f.doc_id, f.source, 1, 0, sub.pos, sub.n, f.node, f.proof FROM f JOIN sub ON sub.source IS NOT DISTINCT FROM f.source WHERE f.tree = 0 AND f.n = 1)
), top AS (SELECT h AS root FROM u WHERE n = 1)
SELECT l.doc_id, l.leaf, s.subroot, top.root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = top.root AS verified
FROM leaf l JOIN sub s ON s.source IS NOT DISTINCT FROM l.source JOIN f ON f.doc_id = l.doc_id AND f.tree = 1 AND f.n = 1, top
"""
