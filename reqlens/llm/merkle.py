"""Merkle manifest of a dataset, kept as logs of tree nodes in postorder.

A leaf is the hash of a row. The leaves of a language ascend by doc_id; every two consecutive nodes become their
hash, a last single one too, until one remains, the language's subroot. The subroots, ordered by language, give the
root in the same way.

A builder takes an aligned run of 2^RUN_BITS nodes and appends every node of its subtree to a log when the node is
complete, so it holds one open node a level. Logs of several runs follow one another in the file of a task. Roots of
runs are the nodes of the next tier, up to one run. A node's position in its log follows from its level and number
alone: the nodes completed before it are those of the full subtrees to its left, 2 m - popcount(m) of them for m
leaves, and all of its own subtree but itself. So a proof reads its siblings from the logs by position; the part of
the path above a run is read once for the whole run.

Only the root itself is collected.

Defined cases: a null is the input "-", any other value its number of UTF-8 bytes, ":" and the value; a null lang
comes first and is a language of its own; a null doc_id comes first in its language and is never tampered with;
rows that repeat a doc_id are ordered by their leaves; a null n_chars stays null, so its row verifies; a lone leaf
is its subroot, and a single subroot the root; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.llm.common import (
    TaskFile,
    arrow_rows,
    open_file,
    shuffle_partitions,
    stored,
    table,
    tidied,
    work_dir,
)
from reqlens.llm.crcsql import CRC32_CTES, crc32_sql
from reqlens.llm.numbering import numbered

RUN_BITS = 10
TAMPER_EVERY = 7
DIGEST = 32
#: An entry of a path: which side the sibling is on, and the sibling.
LEFT, RIGHT, ALONE = b"\0", b"\1", b"\2"
ENTRY = 1 + DIGEST


def node_hash(*digests: bytes) -> bytes:
    """The parent of one or two nodes, whose digests enter as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def height_of(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return max(0, n - 1).bit_length()


def log_size(n: int, height: int) -> int:
    """Nodes in the log of n leaves and ``height`` levels above them."""
    return sum(-(-n >> level) for level in range(height + 1))


def position(level: int, number: np.ndarray, n: int) -> np.ndarray:
    """Places in the log of nodes given by level and number there, in a tree of n leaves."""
    before = number.astype(np.int64) << level
    width = np.minimum(1 << level, n - before)
    own = sum(-(-width >> k) for k in range(level + 1))
    ones = np.array([int(m).bit_count() for m in before], np.int64)
    return 2 * before - ones + own - 1


class Builder:
    """Appends the nodes of one tree of fixed height in the order of their completion."""

    def __init__(self, write: Callable[[bytes], None], height: int):
        self.write, self.height = write, height
        self.open: list[bytes | None] = [None] * (height + 1)
        self.leaves = 0

    def add(self, node: bytes) -> None:
        self.leaves += 1
        self.write(node)
        level = 0
        while self.open[level] is not None:
            node, self.open[level] = node_hash(self.open[level], node), None
            self.write(node)
            level += 1
        self.open[level] = node

    def close(self) -> bytes:
        """Complete what is open from below; the tree's root."""
        right = None
        for level in range(self.height):
            run = [x for x in (self.open[level], right) if x is not None]
            right = None
            if run:
                right = node_hash(*run)
                self.write(right)
        return right if right is not None else self.open[self.height]


def siblings(log: np.ndarray, n: int, height: int, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level from below: whether each leaf's node there has a sibling, whether that is on the left, and
    the sibling's digest. ``log`` holds one digest a row."""
    for level in range(height):
        other = (leaf >> level) ^ 1
        there = other < -(-n >> level)
        yield there, (other & 1) == 0, log[position(level, np.where(there, other, 0), n)]


SEGMENT = pa.schema([("tree", pa.string()), ("run", pa.int64()), ("n", pa.int64()), ("file", pa.string()),
                     ("at", pa.int64()), ("leaves", pa.int64()), ("height", pa.int64()), ("digest", pa.binary())])
SEGMENT_SQL = "tree string, run long, n long, file string, at long, leaves long, height long, digest binary"


def write_logs(nodes: DataFrame, folder: str, tier: int, run_bits: int) -> DataFrame:
    """One row for each run of ``nodes`` (tree, idx, n, digest): where its log is, and the digest of its root."""
    width = 1 << run_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = here = builder = None
        done, at, start = [], 0, 0

        def append(digest: bytes) -> None:
            nonlocal at
            f.write(digest)
            at += 1

        def finish() -> None:
            tree, run, n = here
            done.append((tree, run, n, f.name, start, builder.leaves, builder.height, builder.close()))

        for b in batches:
            for tree, idx, n, digest in zip(*(b.column(c).to_pylist() for c in ("tree", "idx", "n", "digest")), strict=True):
                if f is None:
                    f = TaskFile(folder, f"tier-{tier}-{TaskContext.get().partitionId():06d}", ".log")
                if here != (tree, idx >> run_bits, n):
                    if here is not None:
                        finish()
                    here, start = (tree, idx >> run_bits, n), at
                    builder = Builder(append, run_bits if n > width else height_of(n))
                builder.add(digest)
            if len(done) > 1000:
                yield arrow_rows(SEGMENT, done)
                done = []
        if f is not None:
            finish()
            f.commit()
            yield arrow_rows(SEGMENT, done)

    rows = nodes.select("tree", F.shiftright("idx", run_bits).alias("run"), "idx", "n", "digest")
    rows = rows.repartition(shuffle_partitions(nodes.sparkSession), "tree", "run").sortWithinPartitions("tree", "run", "idx")
    return stored(rows.mapInArrow(tidied(build), SEGMENT_SQL), "segments")


def read_log(folder: str, segment: dict) -> np.ndarray:
    n = log_size(segment["leaves"], segment["height"])
    with open_file(folder, segment["file"]) as f:
        return np.frombuffer(f.read_at(n * DIGEST, segment["at"] * DIGEST), np.uint8).reshape(n, DIGEST)


class Forest:
    """The logs of all trees over ``nodes`` (tree, idx, n, digest), tier by tier."""

    def __init__(self, nodes: DataFrame, run_bits: int = RUN_BITS):
        self.run_bits, self.folder = run_bits, work_dir(nodes.sparkSession, "merkle")
        self.tiers: list[tuple[DataFrame, DataFrame]] = []
        while True:
            segments = write_logs(nodes, self.folder, len(self.tiers), run_bits)
            self.tiers.append((nodes, segments))
            several = segments.filter(F.col("n") > 1 << run_bits)
            if several.isEmpty():
                break
            nodes = several.select("tree", F.col("run").alias("idx"), "digest",
                                   F.shiftright(F.col("n") + ((1 << run_bits) - 1), run_bits).alias("n"))

    def _last(self, segments: DataFrame) -> DataFrame:
        return segments.filter(F.col("n") <= 1 << self.run_bits)

    def roots(self) -> DataFrame:
        """tree, digest."""
        parts = [self._last(s).select("tree", "digest") for _, s in self.tiers]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """The runs of the lowest tier with their log, ``path`` (the entries from the run's root to the top) and
        ``subroot``. ``above`` (tree, path) continues the paths beyond the trees' roots."""
        of_run = None
        for nodes, segments in reversed(self.tiers):
            last = self._last(segments)
            last = (last.join(above, "tree") if above is not None else last.withColumn("path", F.lit(b""))).withColumn(
                "subroot", F.col("digest"))
            if of_run is not None:
                last = last.unionByName(segments.filter(F.col("n") > 1 << self.run_bits).join(of_run, ["tree", "run"]))
            segments = stored(last, "paths")
            if nodes is self.tiers[0][0]:
                return segments
            of_run = self.node_paths(nodes, segments)
        raise AssertionError("a forest has a tier")

    def node_paths(self, nodes: DataFrame, segments: DataFrame) -> DataFrame:
        """tree, run, path, subroot for each node, which is the root of a run of the tier below."""
        folder, width = self.folder, 1 << self.run_bits
        schema = pa.schema([("tree", pa.string()), ("run", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary())])

        def extend(rows: pa.Table, own: pa.Table) -> pa.Table:
            s = own.to_pylist()[0]
            idx = rows["idx"].to_numpy()
            paths = path_entries(read_log(folder, s), s["leaves"], s["height"], idx - s["run"] * width)
            return pa.table([rows["tree"], pa.array(idx), pa.array([p + s["path"] for p in paths], pa.binary()),
                             pa.array([s["subroot"]] * len(idx), pa.binary())], schema=schema)

        return with_logs(nodes, segments, self.run_bits).applyInArrow(
            extend, "tree string, run long, path binary, subroot binary")


def with_logs(nodes: DataFrame, segments: DataFrame, run_bits: int):
    """The cogroup of the nodes of a run and its segment."""
    n = shuffle_partitions(nodes.sparkSession)
    rows = nodes.withColumn("run", F.shiftright("idx", run_bits))
    own = segments.withColumnsRenamed({"tree": "of_tree", "run": "of_run"}).withColumn("run", F.col("of_run"))
    return (rows.repartition(n, "tree", "run").groupBy("tree", "run")
            .cogroup(own.repartition(n, "of_tree", "of_run").groupBy("of_tree", "of_run")))


def path_entries(log: np.ndarray, n: int, height: int, leaf: np.ndarray) -> list[bytes]:
    """The path of each leaf to the root of its log."""
    out: list[list[bytes]] = [[] for _ in leaf]
    for there, left, digest in siblings(log, n, height, leaf):
        for i, p in enumerate(out):
            p.append((LEFT if left[i] else RIGHT) + digest[i].tobytes() if there[i] else ALONE + bytes(DIGEST))
    return [b"".join(p) for p in out]


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and the siblings of its path give."""
    node = leaf
    for at in range(0, len(path), ENTRY):
        side, other = path[at:at + 1], path[at + 1:at + ENTRY]
        node = node_hash(node) if side == ALONE else node_hash(other, node) if side == LEFT else node_hash(node, other)
    return node


def proof_digest(path: bytes) -> str:
    """The hash of a path's siblings."""
    return hashlib.sha256("".join(path[at + 1:at + ENTRY].hex() for at in range(0, len(path), ENTRY)
                                  if path[at:at + 1] != ALONE).encode()).hexdigest()


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(n_chars: Column) -> Column:
    return F.unhex(F.sha2(F.concat(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(n_chars),
                                   field(F.col("text"))), 256))


OUT = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                 ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
OUT_SQL = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
           "verified boolean")


def manifest(docs: DataFrame, run_bits: int = RUN_BITS) -> tuple[Forest, Forest, bytes | None]:
    """The trees of the languages over ``docs``, the tree over their subroots, and the root (None: no rows)."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1)
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPER_EVERY == 0
    leaves = docs.select(F.concat(F.when(F.col("lang").isNull(), "n").otherwise("s"), F.coalesce("lang", F.lit("")))
                         .alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
                         leaf_digest(F.col("n_chars")).alias("digest"),
                         F.when(tampered, leaf_digest(more)).alias("tampered"))
    langs = Forest(numbered(leaves, "tree", "doc_id", "digest"), run_bits)
    roots = langs.roots().withColumnRenamed("tree", "lang").withColumn("tree", F.lit(""))
    top = Forest(numbered(roots, "tree", "lang"), run_bits)
    root = top.roots().first()
    return langs, top, bytes(root["digest"]) if root else None


def verify(langs: Forest, top: Forest, root: bytes | None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf, by proofs from the logs."""
    folder, run_bits = langs.folder, langs.run_bits
    upper = top.paths()
    above = stored(top.node_paths(top.tiers[0][0].select("tree", "idx"), upper).withColumnRenamed("run", "idx").join(
        top.tiers[0][0].select("idx", "lang"), "idx").select(F.col("lang").alias("tree"), "path"), "above")
    segments = langs.paths(above)

    def extract(rows: pa.Table, own: pa.Table) -> pa.Table:
        s = own.to_pylist()[0]
        leaf = rows["idx"].to_numpy() - s["run"] * (1 << run_bits)
        paths = path_entries(read_log(folder, s), s["leaves"], s["height"], leaf)
        out = []
        for doc_id, digest, tampered, path in zip(*(rows[c].to_pylist() for c in ("doc_id", "digest", "tampered")), paths,
                                                  strict=True):
            path += s["path"]
            folded = fold(digest if tampered is None else tampered, path)
            out.append((doc_id, digest.hex(), s["subroot"].hex(), root.hex(), proof_digest(path), folded.hex(),
                        folded == root))
        return pa.Table.from_batches([arrow_rows(OUT, out)])

    return with_logs(langs.tiers[0][0], segments, run_bits).applyInArrow(extract, OUT_SQL)


def op11_postorder_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(*manifest(table(spark, sf_dir, "documents")))


def _field_sql(c: str) -> str:
    c = f"CAST({c} AS VARCHAR)"
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c})) || ':' || {c} END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


ORACLE = f"""
WITH RECURSIVE {CRC32_CTES},
d AS (SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, CASE WHEN n_chars IS NOT NULL AND
      {crc32_sql('CAST(doc_id AS VARCHAR)')} % {TAMPER_EVERY} = 0 THEN {_leaf_sql('n_chars + 1')} END AS bad
   FROM documents CROSS JOIN crctab),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
low AS (SELECT lang, 0 AS lev, idx AS i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM o
        UNION ALL SELECT lang, lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM low
        WHERE n > 1 GROUP BY lang, lev, i // 2),
sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM low WHERE n = 1),
top AS (SELECT 0 AS lev, k AS i, h, count(*) OVER () AS n FROM sub
        UNION ALL SELECT lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM top
        WHERE n > 1 GROUP BY lev, i // 2),
steps AS (
  SELECT o.idx, o.lang, l.lev, l.i AS i, s.h AS h FROM o JOIN low l ON o.lang IS NOT DISTINCT FROM l.lang
    AND l.i = o.idx >> l.lev AND l.n > 1 LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lev = l.lev AND s.i = xor(l.i, 1)
  UNION ALL
  SELECT o.idx, o.lang, 1000 + t.lev, t.i, s.h FROM o JOIN sub ON o.lang IS NOT DISTINCT FROM sub.lang
    JOIN top t ON t.i = sub.k >> t.lev AND t.n > 1 LEFT JOIN top s ON s.lev = t.lev AND s.i = xor(t.i, 1)),
paths AS (SELECT idx, lang, list({{'i': i, 'h': h}} ORDER BY lev) AS p FROM steps GROUP BY idx, lang),
j AS (SELECT o.*, coalesce(p.p, []) AS p FROM o LEFT JOIN paths p ON o.idx = p.idx AND o.lang IS NOT DISTINCT FROM p.lang),
fold AS (SELECT idx, lang, coalesce(bad, leaf) AS h, p, 1 AS step FROM j
         UNION ALL SELECT idx, lang, sha256(CASE WHEN p[step].h IS NULL THEN h WHEN p[step].i % 2 = 1 THEN p[step].h || h
                                                 ELSE h || p[step].h END), p, step + 1 FROM fold WHERE step <= len(p)),
root AS (SELECT h FROM top WHERE n = 1)
SELECT j.doc_id, j.leaf, sub.h AS subroot, root.h AS root,
       sha256(array_to_string([x.h FOR x IN j.p IF x.h IS NOT NULL], '')) AS proof_sha256, f.h AS folded_root,
       f.h = root.h AS verified
FROM j JOIN sub ON j.lang IS NOT DISTINCT FROM sub.lang CROSS JOIN root
JOIN fold f ON f.idx = j.idx AND f.lang IS NOT DISTINCT FROM j.lang AND f.step = len(j.p) + 1
"""
