"""Parts of the operators that need no Spark session, against brute force and the libraries."""
import io
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from reqlens.llm import compression, neardup, packing, pieces, secrets, tokenbin, topk, warc, wordbpe

WORDS = ["a", "B", "é", "É", "ß", "'s", "don't", "<|endoftext|>", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "Σ", "İ", "ſ",
         "ª", "×", "1", "23", "²", "٣", "!", '"', "中文", "😀", "é", "_", "-", "\x00", "ñ", "„", "ﬁ", "▁"]


def texts(parts, n, longest=14, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def test_word_encoder_equals_the_library():
    enc = wordbpe.WordEncoder(wordbpe.word_tokenizer())
    for t in texts(WORDS, 3000):
        ids = np.frombuffer(enc.encode(t), enc.dtype).tolist()
        assert ids == enc.tokenizer.encode(t, add_special_tokens=False).ids, t
    assert enc.encode(None) == enc.encode("") == b""


def test_new_pieces_are_encoded_in_calls_of_bounded_size(monkeypatch):
    enc, sizes = wordbpe.WordEncoder(wordbpe.word_tokenizer()), []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda pieces: (sizes.append(len(pieces)), learn(pieces)))
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = " ".join(a + b + c + d for a in letters for b in letters for c in letters for d in "xyz")
    ids = np.frombuffer(enc.encode(text), enc.dtype).tolist()
    assert ids == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert sum(sizes) == 3 * 26 ** 3 and max(sizes) <= 1 << 13


@pytest.mark.parametrize("bits", [1, 3, 11, 15, 16, 17, 32])
def test_packed_ids_round_trip_and_random_access(bits):
    rnd = random.Random(bits)
    docs = [np.array([rnd.getrandbits(bits) for _ in range(rnd.choice((0, 1, 5, 40)))], "<u4") for _ in range(30)]
    out = io.BytesIO()
    w = tokenbin.Writer(out.write, bits, block_ids=16)
    for i, d in enumerate(docs):
        w.add(None if i == 0 else i, d)
    w.close()
    r = tokenbin.Reader(out)
    whole = np.concatenate(docs)
    assert len(r) == len(whole) and (r.ids(0, len(r)) == whole).all()
    for _ in range(50):
        a = rnd.randint(0, len(whole))
        b = rnd.randint(a, len(whole))
        assert (r.ids(a, b) == whole[a:b]).all()
    for (i, start, ids), (j, d) in zip(r.documents(20), enumerate(docs), strict=True):
        assert i == (None if j == 0 else j) and start == sum(map(len, docs[:j])) and (ids == d).all()


def test_packing_refuses_wide_ids():
    with pytest.raises(ValueError):
        tokenbin.pack(np.array([8], "<u4"), 3)


def test_pieces_equal_the_library():
    enc = pieces.encoder(pieces.piece_model())
    for t in texts([w for w in WORDS if w != "<|endoftext|>"] + ["  ", "\n\n", "the", "ing"], 3000):
        ids, decimal = enc.encode(t)
        assert ids.tolist() == enc.sp.encode(t) and decimal == ",".join(map(str, ids.tolist()))
        for (a, b), p in zip(enc.spans(t, ids).tolist(), enc.sp.encode(t, return_type="proto").pieces, strict=True):
            assert enc.sp.is_byte(p.id) or (a, b) == (p.begin, p.end), t
        assert enc.decode(ids) == enc.sp.decode(enc.sp.encode(t))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_normaliser_with_a_compiled_map(rule):
    from sentencepiece import SentencePieceNormalizer
    ref = SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True,
                                  remove_extra_whitespaces=True)
    own = pieces.Normaliser(ref.serialized_normalizer_spec())
    for t in texts(["a", "É", "ﬁ", "Ａ", "½", "é", " ", "  ", "　", "\t", "▁", "ᄀ", "中", "😀"], 1500):
        data, source = own(t)
        assert data.decode() == ref.normalize(t), t
        assert len(source) == len(data) + 1 and (np.diff(source) >= 0).all() and source[-1] == len(t.encode())


def base_rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    again = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(again),
            len(w) < 50 or 100 * len(again) > 50 * len(w))


def test_base_rules_against_brute_force():
    compress = zstandard.ZstdCompressor(level=compression.LEVEL).compress
    for t in [None, "", *texts(["a", "b", "#", "*", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", "é", "a b c", "\r\n"], 800, 60)]:
        assert tuple(compression.judge(t, compress)[:6]) == base_rules(t), t


def test_compression_bands():
    compress = zstandard.ZstdCompressor(level=compression.LEVEL).compress
    rnd = random.Random(5)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    plain = " ".join(rnd.choice(words) for _ in range(900))
    noise = " ".join("".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
                             for _ in range(60)) for _ in range(100))
    long = " ".join(f"{'x' * 80}{i}" for i in range(300))
    assert compression.judge(plain, compress).kept
    assert not compression.judge(noise, compress).base_failed and not compression.judge(noise, compress).kept
    assert not compression.judge(long, compress).base_failed and not compression.judge(long, compress).kept
    assert sum(map(len, compression.chunks(b"x" * 5000))) == 5000


KEY = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
RULES = [("assign", re.compile(KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
         ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
         ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def test_base_spans_against_plain_patterns():
    parts = ["token", "secret", "PassWord", "api_key", "apikey", "=", ":", " ", "'", '"', "abcdef", "x", "AKIA", "AKIA" + "B" * 10,
             "0123456789abcdef", "zz9", "\n", "é", "K", "ſecret"]
    for t in texts(parts, 4000):
        ref = [(m.start(), m.end(), kind) for kind, p, ok in RULES for m in p.finditer(t) if ok(m)]
        assert secrets.base_spans(t) == sorted(ref, key=lambda s: (s[0], secrets.KINDS.index(s[2]))), t


def test_markov_models_on_held_out_samples():
    rnd = random.Random(9)
    hexes = ["".join(rnd.choice("0123456789abcdef") for _ in range(32)) for _ in range(400)]
    names = ["_".join(rnd.choice(["user", "count", "table", "index", "value", "reader", "total", "width"])
                      for _ in range(4)) for _ in range(800)]
    counts = np.stack([sum(map(secrets.transitions, names[:400])), sum(map(secrets.transitions, hexes[:200]))])
    smooth = counts.reshape(2, secrets.SIZE, secrets.SIZE) + secrets.SMOOTHING
    logs = np.log(smooth / smooth.sum(axis=2, keepdims=True))
    ratio = logs[1] - logs[0]
    assert all(secrets.markov_spans(f"x {h[:23]}.", [], ratio) for h in hexes[200:])
    assert not any(secrets.markov_spans(n, [], ratio) for n in names[400:])


def test_shingles_and_agreements():
    def plain(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    many = texts(["a ", "B ", "b ", "É ", "é ", "c\n"], 300, 12) + [""]
    sets = [neardup.shingles(t) for t in many]
    assert [len(s) for s in sets] == [len(plain(t)) for t in many] and len(neardup.shingles(None)) == 0
    some = [i for i, s in enumerate(sets) if len(s)][:40]
    both = neardup.agreements([sets[i] for i in some], [sets[i] for i in some[:25]], columns=7)
    for x, i in enumerate(some):
        for y, j in enumerate(some[:25]):
            a, b = plain(many[i]), plain(many[j])
            assert both[x, y] == len(a & b)
            assert neardup.linked(sets[i], sets[j]) == (100 * len(a & b) >= 85 * len(a | b))


def test_estimate_rejects_hardly_any_link():
    n = np.array([1000])
    for percent in (neardup.LIMIT, neardup.PERCENT):
        s, k = percent / 100, neardup.SIGNATURE
        rejected = [a for a in range(k + 1) if not neardup.could_link(n, n, np.array([a]), percent)[0]]
        assert sum(math.comb(k, a) * s**a * (1 - s)**(k - a) for a in rejected) < 1e-7


def test_sorted_lists_equal_brute_force():
    rng = np.random.default_rng(3)
    for n, d, spread in ((1, 3, 5), (6, 4, 2), (300, 8, 3), (1500, 16, 50), (40, 0, 1)):
        x = rng.integers(-spread, spread + 1, (n, d))
        ids = rng.permutation(n * 3)[:n]
        lists = topk.SortedLists(ids, x)
        for q, own in [(x[0], ids[0]), (np.zeros(d, int), -1), (-x[n // 2], ids[n // 2])]:
            ref = sorted((-int(r @ q), int(i)) for r, i in zip(x, ids, strict=True) if i != own)[:5]
            assert lists.top(q, int(own), 5) == [(i, -s) for s, i in ref]


def test_sorted_lists_stop_before_their_end():
    """Where few rows lead in every dimension, the others can't reach them after a part of the lists."""
    rng = np.random.default_rng(4)
    n, d = 4096, 8
    x = rng.integers(-20, 21, (n, d))
    x[:40] += 200
    ids = rng.permutation(n)
    lists = topk.SortedLists(ids, x)
    q = np.full(d, 9)
    ref = sorted((-int(r @ q), int(i)) for r, i in zip(x, ids, strict=True))[:5]
    assert lists.top(q, -1, 5) == [(i, -s) for s, i in ref]
    assert 0 < lists.read <= 0.5


def test_sorted_lists_of_large_components():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(0, 1, (300, 6)) * 2.56e12)
    x[7] = x[8]
    x[9], x[10] = 3e38, -3e38
    ids = rng.permutation(300)
    lists = topk.SortedLists(ids, x)
    for q, own in ((x[0], int(ids[0])), (x[9], int(ids[9])), (np.floor(x[1] / 1e9), -1)):
        exact = [sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in x.tolist()]
        held = [max(1 - 2 ** 63, min(2 ** 63 - 1, s)) for s in exact]
        want = sorted((-s, int(i)) for s, i in zip(held, ids, strict=True) if i != own)[:5]
        assert lists.top(q, own, 5) == [(i, -s) for s, i in want]


def test_warc_reader_is_incremental_and_verifies():
    raw = b"".join(warc.encode_record(i, None if i % 2 else f"http://x/{i}\r\nEvil: 1", b"<p>%d</p>" % i * (i % 5),
                                      0 if i == 7 else None) for i in range(20))
    for size in (1, 7, 1 << 16):
        got = [warc.parse_record(m) for m in warc.members(io.BytesIO(raw), size)]
        assert [r.payload_bytes for r in got] == [len(b"<p>%d</p>" % i * (i % 5)) for i in range(20)]
        assert got[7].kind == "revisit" and got[7].headers["warc-refers-to"] == "<urn:page:0>" and got[7].payload == b""
        assert all("evil" not in r.headers for r in got)
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(raw[:-9])))
    one = b"".join(warc.members(io.BytesIO(warc.encode_record(1, None, b"payload"))))
    with pytest.raises(warc.WarcError):
        warc.parse_record(one.replace(b"payload\r\n", b"paYload\r\n"))
    with pytest.raises(warc.WarcError):
        warc.parse_record(one.replace(b"payload\r\n", b"payloads\r\n"))


def test_pack_fills_windows_and_loses_nothing():
    rng = np.random.default_rng(5)
    fragments = [rng.integers(0, 50, n).astype("<u2") for n in [*rng.integers(0, 64, 200), 0, 63, 1]]
    rows = packing.pack(fragments, rng.random(50), 30.0, 64)
    assert all(sum(e - a for _, a, e in r) == 64 for r in rows[:-1])
    held = sorted((f, a, e) for r in rows for f, a, e in r)
    for f, ids in enumerate(fragments):
        spans = [(a, e) for g, a, e in held if g == f]
        assert [a for a, _ in spans] == [0, *(e for _, e in spans)][:len(spans)]
        assert (spans[-1][1] if spans else 0) == len(ids)


def test_bm25_neighbours_equal_brute_force():
    rng = np.random.default_rng(6)
    fragments = [rng.integers(0, 40, rng.integers(1, 20)).astype("<u2") for _ in range(60)]
    idf, mean = rng.random(40) + 0.1, 9.0
    index = packing.Index(fragments, idf, mean)
    unused = rng.random(60) < 0.7
    for seed in range(60):
        terms = sorted(set(fragments[seed].tolist()), key=lambda t: -idf[t])[:packing.QUERY_TERMS]
        score = {}
        for i, f in enumerate(fragments):
            s = 0.0
            for t in terms:
                if tf := int((f == t).sum()):
                    s += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(f) / mean))
            if s > 0 and unused[i]:
                score[i] = s
        got = index.neighbours(seed, unused).tolist()
        assert set(got) == set(score) and all(score[a] >= score[b] - 1e-9 for a, b in zip(got, got[1:], strict=False))


def test_windows_take_all_neighbours_of_a_seed():
    """More short neighbours than a fixed list holds, which share only the seed's commonest id."""
    seed = np.arange(1000, 1900)
    near = [np.array([7, *range(2000 + 10 * i, 2009 + 10 * i)]) for i in range(150)]
    far = [np.arange(5000 + 800 * i, 5800 + 800 * i) for i in range(4)]
    fragments = [x.astype("<u2") for x in [np.append(seed, 7), *near, *far]]
    idf = np.full(10_000, 9.0)
    idf[7] = 0.1
    first = packing.pack(fragments, idf, 30.0, 2048)[0]
    assert [f for f, *_ in first][0] == 0 and sum(e - a for _, a, e in first) == 2048
    assert all(f <= 150 for f, *_ in first) and len(first) == 116


def test_pieces_of_a_run_are_encoded_in_one_call(monkeypatch):
    enc = wordbpe.WordEncoder(wordbpe.word_tokenizer())
    given = ["One two, twos é9 don't", None, "", "two " * 50, "一二 x", "it's <|endoftext|> ÉTÉ\x0b\x1cz"] * 3
    want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in given]
    calls = []
    monkeypatch.setattr(enc, "_learn", lambda new, f=enc._learn: (calls.append(new), f(new)))
    assert [x.tolist() for x in enc.documents(pa.array(given))] == want
    assert len(calls) == 1 and len(set(calls[0])) == len(calls[0])
    monkeypatch.setattr(wordbpe, "RUN_BYTES", 8)
    assert [x.tolist() for x in enc.documents(pa.array(given)[1:])] == want[1:] and len(calls) == 1
    # forgotten pieces, and ids that don't show where pieces end
    enc.pieces = wordbpe.Remembered(1000)
    assert [x.tolist() for x in enc.documents(pa.array(given))] == want
    enc.ends[:] = False
    enc.pieces = wordbpe.Remembered(1000)
    assert [x.tolist() for x in enc.documents(pa.array(given))] == want
    assert list(enc.documents(pa.array([], pa.string()))) == []
