"""Near-duplicate groups by a chosen-path set similarity join.

A document's set holds its distinct 5-word shingles, hashed to 64 bits. Equal sets form a class, which its
smallest doc_id represents from there on; all else runs over classes.

Each class has SIGNATURE minwise tokens. A tree starts by dealing the classes to nodes by the token at one
chosen coordinate; a node that holds more than LEAF classes chooses BRANCHES coordinates of its own and
deals its classes to a child for each token there. Two sets of similarity s agree at a coordinate with
probability s. At the general limit, 0.8, a tree of one level misses a pair with probability 0.2, and one of any
depth with 0.25 at most (the branching process (0.2 + 0.8 q)^2 = q dies out with q = 0.0625); TREES independent
trees miss it with under 1e-6. At 0.85, the limit of op5, it is 0.15, 0.18 at most (q = 0.031), and under 1e-7.

First every class is compared with the smallest class of its root node (a star, linear in the node), and the
links found give components. Then the trees are worked off in ROUNDS, and only nodes that still hold two
components are open: small ones compare all pairs of different components, larger ones branch, and what is
still large after LEVELS branchings (sets that agree almost everywhere, yet are not all linked) compares
the full sets of all pairs, block by block, so no pair of a node is ever dropped. Pairs inside a component
need no comparison, as they cannot change the groups. Small nodes and stars first estimate similarity from
the tokens' low bytes (which agree at least where the tokens do), MARGIN standard deviations below the limit; a
link is always confirmed on the full sets. All trees read one signature, so a pair that the estimate rejects is
rejected in each: with probability P(Binomial(128, 0.8) <= 75) = 2.7e-8 at 0.8, P(Binomial(128, 0.85) <= 84) =
4.3e-8 at 0.85. With the trees' own misses that stays under 1e-6 and 1e-7. The texts for it come from block files in the shared folder, so
texts that no pair needs are never shuffled.

Groups of any size are split: nodes over partitions by hash, stars into chunks, large nodes into blocks.

Defined cases: documents without words, or with a null text, have an empty set and link with nothing; rows
with a null doc_id are linked with nothing, have a null component and are kept; rows that share a doc_id
count as one document with several sets, so a link of any of them links all; an empty table gives no rows;
other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.llm.blocks import packed_texts_of, store_blocks, without_rows
from reqlens.llm.common import arrow_rows, mapped, release, remembered, stored, table, tidied

SHINGLE = 5
#: Sets are linked from this similarity on, in per cent; op5 states a limit of its own.
LIMIT = 80
PERCENT = 85
SIGNATURE = 128
TREES = 10
BRANCHES = 2
LEAF = 128
LEVELS = 1
BLOCK = 768
BLOCK_ITEMS = 1 << 21
ROUNDS = ((0, 0), (1, 3), (4, TREES - 1))
MARGIN = 6
STAR_CHUNK = 256

_ODD = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = np.array([pow(int(_ODD), k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)
_RNG = np.random.Generator(np.random.PCG64(20_240_607))
_A = _RNG.integers(1, 1 << 63, SIGNATURE, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, SIGNATURE, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Bits of each value spread over all of it."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; A-Z count as a-z."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = remembered("shingle words")
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out += _mixed(h[i:len(h) - k + 1 + i]) * _WEIGHTS[i]
    return np.unique(_mixed(out))


def signature(items: np.ndarray) -> np.ndarray:
    """SIGNATURE minwise tokens."""
    out = np.full(SIGNATURE, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(items), 2048):
        out = np.minimum(out, ((items[i:i + 2048, None] * _A + _B) >> np.uint64(32)).min(axis=0))
    return out.astype("<u4")


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def could_link(sizes_a: np.ndarray, sizes_b: np.ndarray, agree: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes, whose signatures agree at so many coordinates, may be linked."""
    s = percent / 100
    least = (s - MARGIN * (s * (1 - s) / SIGNATURE) ** 0.5) * SIGNATURE
    return (agree >= least) & (100 * np.minimum(sizes_a, sizes_b) >= percent * np.maximum(sizes_a, sizes_b))


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (hash of the set, null if empty), sig, low (the low byte of each token) of every
    row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()),
                        ("sig", pa.binary()), ("low", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(text.as_py())
                key = hashlib.md5(s.tobytes(), usedforsecurity=False).digest() if len(s) else None
                sig = signature(s) if len(s) and doc_id is not None else None
                rows.append((doc_id, len(s), key, *((None, None) if sig is None else
                                                    (sig.tobytes(), sig.astype(np.uint8).tobytes()))))
                if len(rows) >= 4096:
                    yield arrow_rows(schema, rows)
                    rows = []
            yield arrow_rows(schema, rows)

    return mapped(
        docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, key binary, sig binary, low binary")


def _token(sig: str, at: Column) -> Column:
    return F.substring(F.col(sig), at * 4 + 1, F.lit(4))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIGNATURE)


def _below(node: Column, levels: int) -> Column:
    """(node, below) of the child for each coordinate that the node chooses; below: its own children."""
    def child(branch: int) -> Column:
        at = F.pmod(F.xxhash64(node, F.lit("coordinate"), F.lit(branch)), F.lit(SIGNATURE)).cast("int")
        own = F.xxhash64(node, at, _token("sig", at))
        return F.struct(own.alias("node"), *([_below(own, levels - 1).alias("below")] if levels > 1 else []))

    return F.array(*map(child, range(BRANCHES)))


def _roots(classes: DataFrame) -> DataFrame:
    """node, rep, tree, below: each class once per tree, at the node of its token at the tree's coordinate. The
    nodes further down are named here, where the tokens are, so that no signature is shuffled for them."""
    step = SIGNATURE // TREES
    rows = classes.select("rep", "sig", F.explode(F.expr(f"sequence(0, {TREES - 1})")).alias("tree")).select(
        F.xxhash64("tree", _token("sig", F.col("tree") * step)).alias("node"), "rep", "tree", "sig")
    below = [_below(F.col("node"), LEVELS).alias("below")] if LEVELS else []
    return rows.select("node", "rep", "tree", *below)


def _shared(members: DataFrame) -> DataFrame:
    """node, rep, n, first for the nodes that hold two classes or more."""
    nodes = stored(members.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("first"))
                   .where("n > 1"), "nodes")
    return members.join(nodes, "node")


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow a link."""
    side = classes.select("rep", "n_shingles", "low")
    both = pairs.join(side.toDF("a", "n_a", "low_a"), "a").join(side.toDF("b", "n_b", "low_b"), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                agree = (_matrix(x["low_a"]) == _matrix(x["low_b"])).sum(axis=1)
                ok = pa.array(could_link(x["n_a"].to_numpy(), x["n_b"].to_numpy(), agree, percent))
                yield pa.RecordBatch.from_arrays([x["a"].filter(ok), x["b"].filter(ok)], schema=schema)

    return both.select("a", "b", "n_a", "n_b", "low_a", "low_b").mapInArrow(tidied(run), "a long, b long")


def _packed_texts(vertices: DataFrame, folder: str, places: DataFrame) -> DataFrame:
    """doc_id, z: the compressed texts of the documents (doc_id), fetched from their block files."""
    wanted = stored(places.join(vertices, "doc_id", "left_semi"), "wanted")
    return stored(packed_texts_of(folder, wanted), "texts")


def _sets(t: pa.Table) -> list[np.ndarray]:
    unpress = zstandard.ZstdDecompressor().decompress
    return [shingles(unpress(z).decode("utf-8", "surrogatepass")) for z in t["z"].to_pylist()]


def _confirmed(pairs: DataFrame, folder: str, places: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets, which are made from the whole texts again."""
    pairs = stored(pairs.distinct(), "pairs")
    # the other ends of a are cut into chunks, each of which gets the text of a once
    sizes = stored(pairs.groupBy("a").agg(F.count("*").alias("n")), "stars")
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / STAR_CHUNK))
                                          .alias("chunk"))
    texts = _packed_texts(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), folder, places)
    left = dealt.select("a", "chunk").distinct().join(texts.toDF("a", "z"), "a").toDF("one", "part", "z")
    right = dealt.join(texts.toDF("b", "z"), "b")
    found = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def confirm(one: pa.Table, others: pa.Table) -> pa.Table:
        sets = _sets(one)
        a = one["one"][0].as_py() if one.num_rows else None
        hits = set()
        for b, t in zip(others["b"].to_pylist(), _sets(others), strict=True):
            if any(linked(s, t, percent) for s in sets):
                hits.add(b)
        return pa.table([pa.array([a] * len(hits), pa.int64()), pa.array(sorted(hits), pa.int64())], schema=found)

    return left.groupBy("one", "part").cogroup(right.groupBy("a", "chunk")).applyInArrow(confirm, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """v, component (the smallest vertex reachable) of every vertex of the links (a, b): labels spread to
    neighbours and jump to their own labels until none changes; every round is stored."""
    edges = stored(links.select(F.col("a").alias("v"), F.col("b").alias("u"))
                   .union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = stored(edges.groupBy("v").agg(F.least("v", F.min("u")).alias("component")), "labels")
    while True:
        near = edges.join(labels.toDF("u", "near"), "u").groupBy("v").agg(F.min("near").alias("near"))
        spread = stored(labels.join(near, "v").select(
            "v", F.least("component", "near").alias("component"), F.col("component").alias("old")), "spread")
        up = spread.select(F.col("v").alias("component"), F.col("component").alias("up"))
        jumped = stored(spread.join(up, "component", "left").select(
            "v", F.coalesce("up", "component").alias("component"), "old"), "labels")
        labels = jumped.select("v", "component")
        if not jumped.where("component <> old").limit(1).count():
            return labels


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """node, rep, component, n (and below) for the nodes that hold two components or more."""
    own = [c for c in members.columns if c in ("node", "rep", "below")]
    of = members.select(*own).join(labels.toDF("rep", "component"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    of = stored(of, "members")
    nodes = stored(of.groupBy("node").agg(F.count("*").alias("n"), F.min("component").alias("lo"),
                                          F.max("component").alias("hi")).where("lo < hi"), "nodes")
    return stored(of.join(nodes.select("node", "n"), "node"), "open")


def _leaf_pairs(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs (a, b) of different components within each small node."""
    rows = members.select("node", "rep", "component").join(classes.select("rep", "n_shingles", "low"), "rep")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(t: pa.Table) -> pa.Table:
        sig, n, rep, comp = _matrix(t["low"]), *(t[c].to_numpy() for c in ("n_shingles", "rep", "component"))
        a, b = [], []
        for i in range(len(rep) - 1):
            others = i + 1 + np.flatnonzero(comp[i + 1:] != comp[i])
            hit = rep[others[could_link(n[others], n[i], (sig[others] == sig[i]).sum(axis=1), percent)]]
            a.append(np.minimum(hit, rep[i]))
            b.append(np.maximum(hit, rep[i]))
        both = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
        return pa.table([pa.array(x, pa.int64()) for x in both], schema=schema)

    return rows.groupBy("node").applyInArrow(compare, "a long, b long")


def agreements(left: list[np.ndarray], right: list[np.ndarray], columns: int = 2048, items: int = 1 << 17) -> np.ndarray:
    """Sizes of all intersections between two lists of sorted sets. The hashes are worked off in ranges that hold
    about so many items of both lists, and the items that two sets share in slices of so many columns, so memory
    beyond the sets and the result doesn't grow with them."""
    out = np.zeros((len(left), len(right)), np.int64)
    ranges = max(1, -(-sum(len(s) for side in (left, right) for s in side) // items))
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    cuts = [[[0, *np.searchsorted(s, edges), len(s)] for s in side] for side in (left, right)]
    for r in range(ranges):
        held = []
        for side, cut in zip((left, right), cuts, strict=True):
            parts = [s[c[r]:c[r + 1]] for s, c in zip(side, cut, strict=True)]
            held.append((np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])))
        shared = np.intersect1d(held[0][0], held[1][0])
        if left is right:  # items of one set alone count for that set only, see below
            found, times = np.unique(held[0][0], return_counts=True)
            shared = found[times > 1]
        if not len(shared):
            continue
        at = [np.searchsorted(shared, x) for x, _ in held]
        at = [np.where(shared[np.minimum(k, len(shared) - 1)] == x, k, -1) for k, (x, _) in zip(at, held, strict=True)]
        for c in range(0, len(shared), columns):
            sides = []
            for k, (_, row), side in zip(at, held, (left, right), strict=True):
                mine = (k >= c) & (k < c + columns)
                m = np.zeros((len(side), min(columns, len(shared) - c)), np.float32)
                m[row[mine], k[mine] - c] = 1
                sides.append(m)
            out += (sides[0] @ sides[1].T).astype(np.int64)
    if left is right:
        np.fill_diagonal(out, [len(s) for s in left])
    return out


def _block_links(members: DataFrame, classes: DataFrame, folder: str, places: DataFrame,
                 percent: int) -> DataFrame:
    """Links (a, b) of different components within large nodes: every pair of blocks of about BLOCK classes, or
    fewer if they hold more than BLOCK_ITEMS shingles, compares full sets, and only links leave it."""
    sized = members.join(classes.select("rep", "n_shingles"), "rep")
    blocks = stored(sized.groupBy("node").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(
        F.sum("n_shingles") / BLOCK_ITEMS)).alias("blocks")), "blocks-of-nodes")
    own = members.join(blocks, "node").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    rows = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).alias("second"), "rep", "component")
    texts = _packed_texts(members.select(F.col("rep").alias("doc_id")).distinct(), folder, places)
    rows = rows.join(texts.toDF("rep", "z"), "rep")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(t: pa.Table) -> pa.Table:
        release()
        sets, rep, comp = _sets(t), t["rep"].to_numpy(), t["component"].to_numpy()
        second = t["second"].to_numpy(zero_copy_only=False)
        left, right = (np.flatnonzero(~second), np.flatnonzero(second)) if second.any() else (np.arange(len(rep)),) * 2
        if not len(left):
            return schema.empty_table()
        one = [sets[i] for i in left]
        both = agreements(one, [sets[i] for i in right] if second.any() else one)
        size = np.array([len(s) for s in sets])
        union = size[left][:, None] + size[right] - both
        x, y = np.nonzero((100 * both >= percent * union) & (comp[left][:, None] != comp[right]))
        p, q = rep[left[x]], rep[right[y]]
        pairs = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return rows.groupBy("node", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, blocks: tuple[str, DataFrame] | None = None, percent: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``, linked from a similarity of ``percent`` on;
    blocks: what ``store_blocks`` gave for them, if they are stored already."""
    rows = stored(_sketches(docs), "sketches")
    full = rows.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(full.groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "low")).alias("x"),
                                             F.count("*").alias("n"))
                     .select("key", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles"), "x.sig", "x.low", "n"), "classes")
    # rows that share a doc_id are one document: their classes are linked
    same = full.select("doc_id", "key").join(classes.select("key", "rep"), "key").where("doc_id <> rep") \
        .select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    many = stored(same.join(full.groupBy("doc_id").agg(F.countDistinct("key").alias("k")).where("k > 1")
                            .select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b"), "same")
    folder, places = blocks or store_blocks(docs.select("doc_id", "text"))
    roots = stored(_shared(_roots(classes)), "members")
    star = roots.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    links = stored(many.union(_confirmed(_plausible(star, classes, percent), folder, places, percent)), "links")
    labels = components(links)
    for first, last in ROUNDS:  # the links of earlier trees close most nodes of the later ones
        members, pairs = roots.where(F.col("tree").between(first, last)), None
        for level in range(LEVELS + 1):
            opened = _open(members, labels)
            found = stored(_leaf_pairs(opened.where(F.col("n") <= LEAF), classes, percent).distinct(), "leaves")
            pairs = found if pairs is None else pairs.union(found)
            large = opened.where(F.col("n") > LEAF)
            if not large.limit(1).count():
                break
            if level < LEVELS:
                members = stored(_shared(large.select("rep", F.inline("below"))).drop("n", "first"), "members")
            else:
                found = _block_links(large, classes, folder, places, percent).distinct()
                links = stored(links.union(found), "links")
        if pairs.limit(1).count():
            links = stored(links.union(_confirmed(pairs, folder, places, percent)), "links")
        labels = components(links)

    of_class = classes.join(labels.toDF("rep", "component_id"), "rep", "left") \
        .where("component_id IS NOT NULL OR n > 1") \
        .select("key", F.coalesce("component_id", "rep").alias("component_id"))
    of_row = stored(labels.toDF("doc_id", "own_component"), "components")
    out = rows.select("doc_id", "n_shingles", "key").join(stored(of_class, "of-class"), "key", "left")
    if many.limit(1).count():
        out = out.join(of_row, "doc_id", "left").withColumn(
            "component_id", F.least("component_id", "own_component")).drop("own_component")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` that represent their group, linked from a similarity of ``percent`` on."""
    folder, places = blocks = store_blocks(docs)
    gone = near_duplicates(docs, blocks, percent).where(~F.col("kept")).select("doc_id").distinct()
    return without_rows(folder, places, stored(places.join(gone, "doc_id", "left_semi"), "duplicates"), docs.schema)


def op5_chosen_path_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=PERCENT)
