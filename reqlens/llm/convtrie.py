"""The prefix trie of conversations, with what sharing their prefixes saves.

A conversation's path is the list of its turns, each given by a digest of role and text. Paths are sorted across all
tasks and cut into shards of SHARD_PATHS. A shard writes its part of the trie as balanced parentheses: findclose with
blocks of least and greatest excess gives each node's subtree, ranks of pairs "()" its leaves, running sums its
members and savings. Only nodes on the first or last path of a shard, its spines, can belong to other shards as well.
What hangs off them is summed by node over the shards, which gives their final figures; then each shard states its
nodes, a spine being stated by the first shard that has it.

Long conversations: a path holds SEGMENT turns at most. What follows belongs to the next layer, a forest whose roots
are the full paths of the layer before, named by a running digest of all turns up to there. Layers are worked from
the deepest up, each handing the figures of its roots to the ends of the paths above. Where only one conversation
goes on, its nodes form a chain and are stated at once. So no task holds a conversation, and the hottest first turn,
path or node is pre-aggregated or cut into shards.

Rebuilding: conversation c takes the first h turns of conversation c - c % 5 (the remainder has the sign of c) and
then its own turns after its first h, h being crc32 of the decimal c modulo HEAD_MODULUS.

Defined cases: a null conv_id names no conversation, its rows take no part; a null role or text is empty; a null turn
comes first, turns of equal number are ordered by the digest of role and text; repeated rows are turns of their own;
a conversation without turns left counts for the root only; an empty table gives no rows, not even a root; other
columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.llm.common import arrow_rows, shuffle_partitions, stored, table, tidied
from reqlens.llm.crcsql import CRC32_CTES, crc32_sql
from reqlens.llm.numbering import part_offsets, sorted_parts
from reqlens.llm.parens import forest_of, subtree_least, subtree_sums

GROUP = 5
HEAD_MODULUS = 9
SEGMENT = 64
SHARD_PATHS = 512
IDS_PER_PIECE = 4096
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def short_digest(data: Column) -> Column:
    return F.substring(F.unhex(F.sha2(data, 256)), 1, 16)


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): conv_id and length of every rebuilt conversation; conv_id, pos, digest, bytes and
    length of its turns."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.octet_length(text).cast("long").alias("bytes"),
        short_digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"))
    rows = sorted_parts(rows, "conv_id", F.col("turn").asc_nulls_first(), "digest")
    parts = stored(part_offsets(rows, "conv_id"), "parts")
    convs = parts.groupBy("conv_id").agg(F.max("n").alias("n")).withColumn(
        "head", F.crc32(F.col("conv_id").cast("string")) % HEAD_MODULUS).withColumn(
        "base", F.col("conv_id") - F.col("conv_id") % GROUP)
    of_base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = convs.join(of_base, "base", "left").withColumn(
        "lead", F.least("head", F.coalesce("n_base", F.lit(0)))).withColumn(
        "length", F.col("lead") + F.greatest(F.col("n") - F.col("head"), F.lit(0)))
    plan = stored(plan.select("conv_id", "base", "head", "lead", "length"), "rebuilt")
    # a conversation in many sorted parts meets its plan once a part, not once a turn
    own = rows.join(parts.join(plan, "conv_id"), ["part", "conv_id"]).withColumn("idx", F.col("row") + F.col("shift"))
    own = stored(own.select("conv_id", "idx", "digest", "bytes", "head", "lead", "length"), "numbered-turns")
    tail = own.filter("idx >= head").select("conv_id", (F.col("idx") - F.col("head") + F.col("lead")).alias("pos"),
                                            "digest", "bytes", "length")
    first = own.filter(F.col("idx") < HEAD_MODULUS).select(F.col("conv_id").alias("base"), "idx", "digest", "bytes")
    lead = plan.filter("lead > 0").join(first, "base").filter("idx < lead").select(
        "conv_id", F.col("idx").alias("pos"), "digest", "bytes", "length")
    return plan.select("conv_id", "length"), lead.unionByName(tail)


def segments_of(convs: DataFrame, turns: DataFrame, segment: int) -> DataFrame:
    """conv_id, layer, root, key (digests of at most ``segment`` turns), sizes, nid (the node at its end), ends
    (whether the conversation ends there)."""
    part = F.array_sort(F.collect_list(F.struct("pos", "digest", "bytes")))
    seg = turns.withColumn("layer", F.expr(f"pos div {segment}")).groupBy("conv_id", "layer", "length").agg(
        part.alias("part"))
    seg = seg.select("conv_id", "layer", "length", F.col("part.digest").alias("key"), F.col("part.bytes").alias("sizes"))
    bare = convs.filter("length = 0").select(
        "conv_id", F.lit(0).cast("long").alias("layer"), "length", F.array().cast("array<binary>").alias("key"),
        F.array().cast("array<bigint>").alias("sizes"))
    joined = F.aggregate("key", F.lit(b""), lambda a, x: F.concat(a, x))
    seg = stored(seg.unionByName(bare).withColumn("sum", F.unhex(F.sha2(joined, 256))), "segments")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("layer", pa.int64()), ("root", pa.binary())])
        last, root = None, ROOT
        for b in batches:
            out = []
            for conv, layer, digest in zip(*(b.column(c).to_pylist() for c in ("conv_id", "layer", "sum")), strict=True):
                root = node_id(ROOT if conv != last else root, digest)
                last = conv
                out.append((conv, layer + 1, root))
            if out:
                yield arrow_rows(schema, out)

    # a segment that another follows names the root of the next; 32 bytes for each run of turns pass here
    full = seg.filter(F.col("length") > (F.col("layer") + 1) * segment).select("conv_id", "layer", "sum")
    roots = full.repartition(shuffle_partitions(seg.sparkSession), "conv_id").sortWithinPartitions(
        "conv_id", "layer").mapInArrow(tidied(chain), "conv_id long, layer long, root binary")
    first = seg.filter("layer = 0").withColumn("root", F.lit(ROOT))
    later = seg.filter("layer > 0").join(roots, ["conv_id", "layer"])
    end = F.when(F.size("key") > 0, short_digest(F.concat("root", "sum"))).otherwise(F.col("root"))
    return stored(first.unionByName(later.select(first.columns)).select(
        "conv_id", "layer", "root", "key", "sizes", end.alias("nid"),
        (F.col("length") <= (F.col("layer") + 1) * segment).alias("ends")), "rooted-segments")


def node_id(root: bytes, digests_sum: bytes) -> bytes:
    return hashlib.sha256(root + digests_sum).digest()[:16]


def end_hashes(segments: DataFrame) -> DataFrame:
    """nid, ends_sha256: the hash of the ascending ids of the conversations that end at a node. Ids pass as pieces
    of joined text in order, so that the task of a node at which very many end only feeds its hash."""
    rows = sorted_parts(segments.filter("ends").select("nid", "conv_id"), "nid", "conv_id")
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = rows.withColumn("piece", F.expr(f"row div {IDS_PER_PIECE}")).groupBy("nid", "part", "piece").agg(
        F.min("conv_id").alias("first"), F.array_join(ids, ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("nid", pa.binary()), ("ends_sha256", pa.string())])
        here = h = None
        for b in batches:
            out = []
            for nid, ids in zip(b.column("nid").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if nid != here:
                    if here is not None:
                        out.append((here, h.hexdigest()))
                    here, h = nid, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if out:
                yield arrow_rows(schema, out)
        if here is not None:
            yield arrow_rows(schema, [(here, h.hexdigest())])

    return pieces.repartition(shuffle_partitions(segments.sparkSession), "nid").sortWithinPartitions(
        "nid", "first").select("nid", "ids").mapInArrow(tidied(digest), "nid binary, ends_sha256 string")


class Shard:
    """A run of sorted paths as balanced parentheses, with the figures that the shard alone can give.

    Figures of a node count what lies below it in the shard; those of spine nodes leave other spine nodes out, which
    are added when the shards are merged."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("row")
        self.rows = {c: rows[c].to_pylist() for c in rows.column_names}
        r = self.rows
        self.paths = [(root, *key) for root, key in zip(r["root"], r["key"], strict=True)]
        self.parens, self.parent, self.path, self.level = forest_of(self.paths)
        n, sizes = len(self.parens), self.parens.sizes()
        ends_here = np.array([len(p) for p in self.paths])[self.path] == self.level + 1
        self.end_of = np.where(ends_here, self.path, -1)

        def own(column: str, otherwise: int = 0) -> np.ndarray:
            values = np.array([otherwise if x is None else x for x in r[column]] + [otherwise], np.int64)
            return np.where(ends_here, values[self.path], otherwise)

        self.bytes = np.array([0 if k == 0 else r["sizes"][p][k - 1] for p, k in zip(self.path, self.level, strict=True)],
                              np.int64)
        self.members = subtree_sums(own("n"), sizes)
        self.least = subtree_least(own("lo", np.iinfo(np.int64).max), sizes)
        below = own("kids")
        # spines: the first path, the last path and all roots
        self.spine = self.level == 0
        self.spine[:len(self.paths[0])] = True
        at = n - 1  # the last path ends at the last node
        while at >= 0:
            self.spine[at] = True
            at = self.parent[at]
        leaf = self.parens.leaf_pairs() & (below == 0) & ~self.spine
        gain = np.where(self.spine, 0, (self.members - 1) * self.bytes)
        leaves = subtree_sums(leaf + own("leaves"), sizes)
        saved = subtree_sums(gain + own("saved"), sizes)
        inner = ~self.spine
        kids = below.copy()
        np.add.at(kids, self.parent[inner], 1)
        self.kids, self.leaves, self.saved = kids, leaves, saved
        # what hangs off a spine node: its own share and its inner children's subtrees
        for mine, figure in (("leaves", self.leaves), ("saved", self.saved)):
            hanging = own(mine)
            top = inner & (self.parent >= 0)
            top[top] = self.spine[self.parent[top]]
            np.add.at(hanging, self.parent[top], figure[top])
            figure[self.spine] = hanging[self.spine]

    def name(self, node: int) -> bytes:
        root, *key = self.paths[self.path[node]][:self.level[node] + 1]
        return node_id(root, hashlib.sha256(b"".join(key)).digest()) if key else root


SPINE = pa.schema([("shard", pa.int64()), ("nid", pa.binary()), ("parent", pa.binary()), ("level", pa.int64()),
                   ("bytes", pa.int64()), ("up", pa.list_(pa.binary())), ("n", pa.int64()), ("lo", pa.int64()),
                   ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())])
SPINE_SQL = ("shard long, nid binary, parent binary, level long, bytes long, up array<binary>, n long, lo long, "
             "kids long, leaves long, saved long")
NODE = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
                  ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                  ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
NODE_SQL = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
            "saved_tokens long, ends_sha256 string")


def spine_rows(rows: pa.Table) -> pa.Table:
    s = Shard(rows)
    out, names = [], {}
    shard = rows["shard"][0].as_py()
    for i in np.flatnonzero(s.spine).tolist():
        up = [*names.get(int(s.parent[i]), []), s.name(i)]
        names[i] = up
        out.append((shard, up[-1], up[-2] if len(up) > 1 else None, int(s.level[i]), int(s.bytes[i]), up, int(s.members[i]),
                    int(s.least[i]), int(s.kids[i]), int(s.leaves[i]), int(s.saved[i])))
    return pa.Table.from_batches([arrow_rows(SPINE, out)])


def merged_spines(spines: DataFrame) -> DataFrame:
    """nid, level, n, lo, kids, leaves, saved, owner of every spine node, over all shards."""
    own = spines.groupBy("nid", "parent", "level", "bytes", "up").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.min("shard").alias("owner"))
    own = stored(own, "spines")
    below = own.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("nid")).agg(F.count("*").alias("more"))
    own = stored(own.join(below, "nid", "left").withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0))), "spines")
    shares = own.select(F.explode("up").alias("nid"),
                        (F.col("leaves") + (F.col("kids") == 0).cast("long")).alias("leaves"),
                        (F.col("saved") + (F.col("n") - 1) * F.col("bytes")).alias("saved"))
    sums = shares.groupBy("nid").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return stored(own.select("nid", "level", "n", "lo", "kids", "owner").join(sums, "nid"), "merged-spines")


def layer_nodes(paths: DataFrame, layer: int, segment: int, shard_paths: int, above: DataFrame | None,
                ) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots) of a layer: its rows of the result, and the figures of its roots. ``above`` (nid, top) has the
    smallest member of each root, which the paths of the layer before know."""
    rows = sorted_parts(paths, "root", "key").withColumn(
        "shard", F.shiftleft("part", 33) + F.expr(f"row div {shard_paths}")).drop("part")
    rows = stored(rows, "shards")
    spines = stored(rows.groupBy("shard").applyInArrow(spine_rows, SPINE_SQL), "shard-spines")
    merged = merged_spines(spines)
    final = merged if above is None else merged.join(above, "nid", "left").withColumn(
        "lo", F.coalesce("top", "lo")).drop("top")
    known = spines.select(F.col("shard").alias("of"), "nid").join(final, "nid")
    base = layer * segment

    def state(rows: pa.Table, spine: pa.Table) -> pa.Table:
        s = Shard(rows)
        shard, figures = rows["shard"][0].as_py(), {x["nid"]: x for x in spine.to_pylist()}
        least, members, owned = s.least.copy(), s.members.copy(), np.ones(len(s.parens), bool)
        kids, leaves, saved = s.kids.copy(), s.leaves.copy(), s.saved.copy()
        for i in np.flatnonzero(s.spine).tolist():
            x = figures[s.name(i)]
            least[i], members[i], kids[i], leaves[i], saved[i] = x["lo"], x["n"], x["kids"], x["leaves"], x["saved"]
            owned[i] = x["owner"] == shard and (s.level[i] > 0 or layer == 0)
        at = np.flatnonzero(owned)
        up = s.parent[at]
        ends = [NO_ENDS if p < 0 else s.rows["ends_sha256"][p] or NO_ENDS for p in s.end_of[at].tolist()]
        return pa.table([pa.array(least[at]), pa.array(s.level[at] + base),
                         pa.array(least[np.maximum(up, 0)], pa.int64(), mask=up < 0), pa.array(members[at]),
                         pa.array(kids[at]), pa.array(leaves[at]), pa.array(saved[at]), pa.array(ends, pa.string())],
                        schema=NODE)

    nodes = rows.groupBy("shard").cogroup(known.groupBy("of")).applyInArrow(state, NODE_SQL)
    return nodes, merged.filter("level = 0").select("nid", "kids", "leaves", "saved")


def lone_chains(segments: DataFrame, paths: DataFrame, ends: DataFrame, segment: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots) of what lies below roots that only one conversation passes."""
    alone = segments.filter("layer > 0").groupBy("layer", "root").agg(F.count("*").alias("n")).filter("n = 1")
    own = segments.join(alone.select("layer", "root"), ["layer", "root"])
    first = own.groupBy("conv_id").agg(F.min("layer").alias("first"))
    tops = own.join(first, "conv_id").filter("layer = first").join(
        paths.filter(F.size("key") == segment).select(F.col("nid").alias("root"), F.col("lo").alias("top")), "root")
    tops = tops.select("conv_id", "layer", "root", "top")
    turn = own.join(tops.select("conv_id", "layer", "top"), ["conv_id", "layer"], "left").join(
        ends, "nid", "left").select("conv_id", "layer", "top", "ends_sha256", "ends", F.size("key").alias("m"),
                                    F.posexplode("key").alias("k", "digest"))
    last = F.col("ends") & (F.col("k") == F.col("m") - 1)
    one = F.lit(1).cast("long")
    nodes = turn.select(
        "conv_id", (F.col("layer") * segment + F.col("k") + 1).alias("depth"),
        F.when(F.col("k") == 0, F.coalesce("top", "conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.col("ends_sha256")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"))
    return nodes, tops.select(F.col("root").alias("nid"), one.alias("kids"), one.alias("leaves"),
                              F.lit(0).cast("long").alias("saved"))


def prefix_trie(turns: DataFrame, segment: int = SEGMENT, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations."""
    segments = segments_of(*rebuilt_turns(turns), segment)
    ends = stored(end_hashes(segments), "ends")
    paths = segments.groupBy("layer", "root", "key", "sizes", "nid").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("lo"))
    paths = stored(paths.join(ends, "nid", "left"), "paths")
    deepest = paths.agg(F.max("layer")).first()[0]
    if not deepest:
        none = {c: F.lit(0).cast("long") for c in ("kids", "leaves", "saved")}
        return layer_nodes(paths.withColumns(none), 0, segment, shard_paths, None)[0]
    nodes, hanging = lone_chains(segments, paths, ends, segment)
    alone = segments.filter("layer > 0").groupBy("layer", "root").agg(F.count("*").alias("n")).filter("n = 1")
    shared = stored(paths.join(alone.select("layer", "root"), ["layer", "root"], "left_anti"), "shared-paths")
    tops = paths.filter(F.size("key") == segment).select("nid", F.col("lo").alias("top"))
    for layer in range(shared.agg(F.max("layer")).first()[0], -1, -1):
        own = shared.filter(F.col("layer") == layer).join(hanging, "nid", "left")
        more, roots = layer_nodes(own, layer, segment, shard_paths, tops if layer else None)
        nodes, hanging = nodes.unionByName(stored(more, "nodes")), stored(hanging.unionByName(roots), "hanging")
    return nodes


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH RECURSIVE {CRC32_CTES},
t AS (SELECT conv_id, r, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        sha256(octet_length(encode(r)) || ':' || r || x)) - 1 AS i
      FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
            WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {crc32_sql('CAST(conv_id AS VARCHAR)')} % {HEAD_MODULUS} AS h
      FROM (SELECT DISTINCT conv_id FROM t) CROSS JOIN crctab),
u AS (SELECT c.conv_id, 0 AS own, i, r, x FROM c JOIN t ON t.conv_id = c.base AND t.i < c.h
      UNION ALL SELECT c.conv_id, 1, i, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND t.i >= c.h),
s AS (SELECT conv_id, x, row_number() OVER w AS d, list({{'r': r, 'x': x}}) OVER w AS k FROM u
      WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
len AS (SELECT c.conv_id, coalesce(max(d), 0) AS d FROM c LEFT JOIN s ON s.conv_id = c.conv_id GROUP BY c.conv_id),
n AS (
  SELECT s.d, s.k, count(*) AS n, min(s.conv_id) AS lo, any_value(octet_length(encode(s.x))) AS b,
         string_agg(CAST(s.conv_id AS VARCHAR), ',' ORDER BY s.conv_id) FILTER (WHERE s.d = len.d) AS e
  FROM s JOIN len ON len.conv_id = s.conv_id GROUP BY s.d, s.k
  UNION ALL
  SELECT 0, [], count(*), min(conv_id), 0, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = 0)
  FROM len HAVING count(*) > 0),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k),
up AS (SELECT m.d, m.k, m.n, m.b, m.kids, unnest(range(0, m.d + 1)) AS a FROM m),
sub AS (SELECT a AS d, k[1:a] AS k, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * b) AS saved
        FROM up GROUP BY ALL)
SELECT m.lo AS conv_id, CAST(m.d AS BIGINT) AS depth, p.lo AS parent_conv_id, CAST(m.n AS BIGINT) AS n_convs,
       CAST(m.kids AS BIGINT) AS n_children, CAST(sub.leaves AS BIGINT) AS n_leaves,
       CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.e, '')) AS ends_sha256
FROM m JOIN sub ON sub.d = m.d AND sub.k = m.k LEFT JOIN n p ON p.d = m.d - 1 AND p.k = m.k[1:m.d - 1]
"""
