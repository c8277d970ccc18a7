"""Merkle manifest, chunk recipes and the conversation trie against brute force."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from reqlens.llm import convtrie, exactdup, merkle, numbering, parens, queries

BIG = 2 ** 63 - 1


def same(df, want):
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# ---------------------------------------------------------------- numbering

def test_numbers_within_groups(spark):
    rnd = random.Random(1)
    rows = [("a" if rnd.random() < 0.6 else rnd.choice("bcd"), rnd.choice([None, 1, 2, 3])) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = numbering.numbered(df, "g", "v").collect()
    for g in "abcd":
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["idx"])
        assert [r["idx"] for r in mine] == list(range(len(mine))) and {r["n"] for r in mine} == {len(mine)}
        values = [-1 if r["v"] is None else r["v"] for r in mine]
        assert values == sorted(values)


# ---------------------------------------------------------------- manifest

def hex_hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([hex_hash(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path_of(tree, i):
    out = []
    for nodes in tree[:-1]:
        out.append((i & 1, nodes[i ^ 1] if i ^ 1 < len(nodes) else None))
        i >>= 1
    return out


def brute_manifest(rows):
    """rows of (doc_id, source, lang, n_chars, text)."""
    def leaf(r, more=0):
        r = [*r[:3], None if r[3] is None else r[3] + more, r[4]]
        return hex_hash(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))

    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {k: sorted(by_lang[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in langs}
    trees = {k: levels([leaf(r) for r in ordered[k]]) for k in langs}
    top = levels([trees[k][-1][0] for k in langs])
    out = []
    for j, k in enumerate(langs):
        for i, r in enumerate(ordered[k]):
            path = path_of(trees[k], i) + path_of(top, j)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1) if bad and r[3] is not None else leaf(r)
            for right, other in path:
                node = hex_hash(node) if other is None else hex_hash(other, node) if right else hex_hash(node, other)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], hex_hash(*(s for _, s in path if s)), node,
                        node == top[-1][0]))
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx long, n long, digest string"


def docs_of(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, g, s, c, "x", 1, 2, "y") for i, s, g, c, t in rows], DOCS).repartition(parts)


@pytest.mark.parametrize("n,run_bits", [(1, 2), (2, 1), (37, 1), (37, 2), (40, 10)])
def test_manifest_equals_brute_force(spark, n, run_bits):
    rnd = random.Random(n)
    rows = [(rnd.choice([None, i, i, i, 3]), rnd.choice(["s", None, ""]), rnd.choice(["en", "en", "en", None, "é", "z"]),
             rnd.choice([None, i, BIG]), rnd.choice([None, "", f"text {i}", "é" * i])) for i in range(n)]
    same(merkle.verify(*merkle.manifest(docs_of(spark, rows), run_bits)), brute_manifest(rows))


def test_manifest_of_repeated_rows_and_of_none(spark):
    rows = [(None, None, None, None, None)] * 9 + [(7, "s", "en", 1, "t")] * 5
    same(merkle.verify(*merkle.manifest(docs_of(spark, rows), 2)), brute_manifest(rows))
    assert merkle.verify(*merkle.manifest(docs_of(spark, []))).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 31, 64])
def test_log_positions_follow_from_level_and_number(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    for height in {merkle.height_of(n), 7}:
        log = []
        b = merkle.Builder(log.append, height)
        for x in leaves:
            b.add(x)
        root = b.close()
        assert len(log) == merkle.log_size(n, height) and log[-1] == root
        nodes = leaves
        for level in range(height + 1):
            at = merkle.position(level, np.arange(len(nodes)), n)
            assert [log[i] for i in at] == nodes
            nodes = [merkle.node_hash(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]


# ---------------------------------------------------------------- chunk recipes

def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdehlptx,.0") for _ in range(rnd.randint(1, 9))) for _ in range(n))


def brute_duplicates(rows):
    out, groups = [], {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        top = max(known, default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, -(i or 0)))):
            out.append((i, top, len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def copies(spark):
    rnd = random.Random(4)
    base = words(rnd, 900)
    rows = [(1, base), (2, base + " "), (3, base), (4, words(rnd, 3) + " " + base), (5, None), (6, ""), (None, ""), (7, "a"),
            (7, "a"), (None, "b"), (None, "b"), (8, "中" * 5000), (9, "中" * 5000), (10, "中" * 4999), (11, "x" * 300000),
            (12, "x" * 300000), (13, "é\n" * 50), (14, "\0 \0"), (15, "\0 \0")] + [(100 + i, base) for i in range(60)]
    schema = "doc_id long, text string, recipe string, salt string, rid string, n string"
    return rows, spark.createDataFrame([(i, t, "r", "s", "q", "m") for i, t in rows], schema).repartition(4)


def test_duplicates_equal_brute_force(copies):
    rows, df = copies
    got = exactdup.duplicate_groups(df)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_chunks"]
    same(got.drop("n_chunks"), brute_duplicates(rows))
    assert exactdup.duplicate_groups(df.filter("false")).collect() == []


def test_chunks_join_to_the_text_and_survive_an_insertion(spark):
    rnd = random.Random(9)
    text = words(rnd, 4000)
    rows = [("a", text), ("b", "pushed " + text), ("c", "中" * 9000), ("d", ""), ("e", "\U0001f600é" * 3000)]
    got = {r["k"]: r for r in spark.createDataFrame(rows, "k string, text string").select(
        "k", "text", exactdup.chunks_of(F.col("text")).alias("c")).collect()}
    for r in got.values():
        assert "".join(r["c"]) == r["text"]
        assert all(len(c) <= exactdup.MAX_CHUNK for c in r["c"]) and all(len(c) >= exactdup.MIN_CHUNK for c in r["c"][:-1])
    assert len(got["a"]["c"]) > 20
    assert len(set(got["a"]["c"]) & set(got["b"]["c"])) > len(got["a"]["c"]) / 2


def test_identifiers_that_clash_are_renamed(copies):
    rows, df = copies

    def weak(chunk, attempt):
        return exactdup.two_hashes(chunk, attempt) if attempt > 1 else [F.length(chunk).cast("long"), F.lit(attempt).cast("long")]

    texts = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assert not exactdup.clashes(texts, weak, 0).isEmpty() and exactdup.verified_attempt(texts, weak) == 2
    assert exactdup.verified_attempt(texts) == 0
    same(exactdup.duplicate_groups(df, weak).drop("n_chunks"), brute_duplicates(rows))


def test_duplicates_need_no_python_worker(copies):
    plan = exactdup.duplicate_groups(copies[1])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapPartitions" not in plan


# ---------------------------------------------------------------- conversations

def test_parentheses_against_a_stack():
    rnd = random.Random(3)
    paths = sorted({tuple(rnd.choice("ab") for _ in range(rnd.randint(0, 9))) for _ in range(200)})
    paths = [("r", *p) for p in paths]
    p, parent, of_path, level = parens.forest_of(paths)
    nodes = sorted({q[:k] for q in paths for k in range(1, len(q) + 1)})
    assert [paths[a][:b + 1] for a, b in zip(of_path, level, strict=True)] == nodes
    stack, close = [], {}
    for i, b in enumerate(p.bits):
        if b:
            stack.append(i)
        else:
            close[stack.pop()] = i
    assert p.findclose(p.open_at).tolist() == [close[i] for i in p.open_at.tolist()]
    sizes = p.sizes()
    for i, x in enumerate(nodes):
        mine = [j for j, y in enumerate(nodes) if y[:len(x)] == x]
        assert sizes[i] == len(mine) and (parent[i] < 0 or nodes[parent[i]] == x[:-1])
        values = np.arange(len(nodes))[::-1].copy()
        assert parens.subtree_sums(values, sizes)[i] == values[mine].sum()
        assert parens.subtree_least(values, sizes)[i] == values[mine].min()


def brute_trie(rows):
    """rows of (conv_id, turn, role, text)."""
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for v in turns.values():
        v.sort(key=lambda q: (q[0], q[1], hashlib.sha256(f"{len(q[2].encode())}:{q[2]}{q[3]}".encode()).hexdigest()))
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(q[2:] for q in turns.get(base, [])[:h] + turns[c][h:])
    nodes = {}
    for c, p in built.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        kids = sum(len(q) == len(p) + 1 for q in below)
        leaves = sum(not any(len(y) == len(q) + 1 and y[:-1] == q for y in below) for q in below)
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids, leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return out


def chats(seed, n, longest):
    rnd = random.Random(seed)
    rows = []
    for c in range(-7, n):
        if rnd.random() < 0.15:
            continue
        script = [(rnd.choice(["u", "a", None]), rnd.choice(["", None, "hé", "x"])) for _ in range(longest)]
        script = [("u", "same")] * longest if rnd.random() < 0.6 else script
        for t in range(rnd.randint(1, longest)):
            rows.append((c, rnd.choice([None, 1]) if t == 0 else t, *script[t]))
    return rows + [(None, 1, "u", "lost")] + rows[:3]


CHATS = "conv_id long, turn long, role string, text string, n string, pos string, layer string, key string"


def chats_of(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], CHATS).repartition(4)


@pytest.mark.parametrize("segment,shard_paths", [(64, 512), (64, 2), (2, 3), (1, 1)])
def test_trie_equals_brute_force(spark, segment, shard_paths):
    rows = chats(segment + shard_paths, 30, 6 if segment < 3 else 20)
    same(convtrie.prefix_trie(chats_of(spark, rows), segment, shard_paths), brute_trie(rows))


def test_trie_of_long_and_of_common_conversations(spark):
    rows = [(c, t, "u", f"w{t}") for c in (1000, 1001, 1002) for t in range(150 - c % 5)] + [
        (2000 + 5 * i, t, "a", "hot") for i in range(40) for t in range(2)]
    same(convtrie.prefix_trie(chats_of(spark, rows), 16, 4), brute_trie(rows))


def test_trie_of_nothing(spark):
    assert convtrie.prefix_trie(chats_of(spark, [])).collect() == []
    assert convtrie.prefix_trie(chats_of(spark, [(None, None, None, None)])).collect() == []
    alone = [(3, 1, "u", "x")]  # conversation 0 is absent and the head takes all of it: only the root is left
    same(convtrie.prefix_trie(chats_of(spark, alone)), brute_trie(alone))


def test_hash_of_many_ends(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "IDS_PER_PIECE", 3)
    rows = [(5 * i, 1, "u", "x") for i in range(1, 60)]
    same(convtrie.prefix_trie(chats_of(spark, rows)), brute_trie(rows))


# ---------------------------------------------------------------- registered queries

@pytest.mark.parametrize("name", ["op11_postorder_manifest", "op12_chunk_recipes", "op13_prefix_trie"])
def test_registered_queries_equal_their_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF_SMALL)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE[name]})").fetchall()
    same(df, want)
