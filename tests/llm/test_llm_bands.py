"""Compression bands learned from trusted texts, against brute force."""
import random

import numpy as np
import zstandard

from reqlens.llm import compression


def prose(rnd, n, words):
    return " ".join(rnd.choice(words) for _ in range(n))


def corpus():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(900)]
    few = words[:30]
    good = [(i, prose(rnd, rnd.randint(80, 700), words)) for i in range(300)]
    bad = [(1000 + i, prose(rnd, 300, few)) for i in range(20)]  # thirty words in random order: few repeated windows
    return good, bad


def test_learned_bands_equal_quantiles_of_trusted_texts(spark):
    good, bad = corpus()
    docs = spark.createDataFrame([*good, *bad, (None, good[0][1]), (2000, None), (2001, "")], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(good[0][0], 1), (None, 1), (2000, 1), (2001, 1), (77777, 1)]
                                   + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    got = compression.learned_bands(compression.measured(docs), labels)
    compress = zstandard.ZstdCompressor(level=compression.LEVEL).compress
    shares, chunks = {}, []
    for _, t in good:
        v = compression.judge(t, compress)
        if not v.base_failed:
            shares.setdefault(compression.Bands().of(len(t.encode())), []).append(int(v.whole_share * 1000))
            chunks += [int(x * 1000) for x in compression.chunk_shares(t.encode(), compress)]
    learned = 0
    for i, (least, low, high) in enumerate(got.whole):
        x = sorted(shares.get(i, []))
        if len(x) < compression.LEAST_TRUSTED:
            assert (least, low, high) == compression.BANDS[i]
            continue
        learned += 1
        cut = int(compression.TAIL * len(x))
        assert (least, low, high) == (compression.BANDS[i][0], x[cut] / 1000, (x[-1 - cut] + 1) / 1000)
    assert learned
    x = sorted(chunks)
    cut = int(compression.TAIL * len(x))
    assert got.chunk == (x[cut] / 1000, (x[-1 - cut] + 1) / 1000)
    # the bands decide: texts of thirty words pass the base rules and are rejected, trusted ones stay
    verdicts = {r["doc_id"]: r for r in compression.quality(docs, got).collect()}
    want = {i: compression.judge(t, compress, got).kept for i, t in [*good, *bad]}
    assert {i: verdicts[i]["kept"] for i in want} == want
    assert not any(verdicts[i]["base_failed"] or verdicts[i]["kept"] for i, _ in bad)
    assert np.mean([verdicts[i]["kept"] for i, _ in good]) > 0.97
    kept = sorted(i for (i,) in compression.keep_quality(docs, got).where("doc_id IS NOT NULL").select("doc_id").collect())
    assert kept == sorted(i for i, k in want.items() if k)


def test_bands_without_trusted_texts_are_the_fixed_ones(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert compression.learned_bands(compression.measured(docs), none) == compression.Bands()
    assert compression.learned_bands(compression.measured(docs.filter("false")), none) == compression.Bands()
