"""Every operator against brute force on odd tables: nulls, empty and long texts, copies, ties, clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, hashing, jaccard, lines, lm, media, packing, quality, substrings, topk, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, ids string, score string, sequence_id string, a string"


def texts():
    rnd = random.Random(5)
    words = [f"{a}{b}" for a in ("the", "ou", "Re", "é", "ing") for b in ("er", "st", "x1", "an", "ß")]
    para = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, long = para(60), para(1500)
    near = [" ".join(w if rnd.random() > 0.01 else "zz" for w in base.split()) for _ in range(6)]
    shared = para(30)
    out = [None, "", " ", "\n\n", "a", "ab  c\n\tD ", base, base, base, *near, long, long + " end", shared, para(20) + "\n" + shared + "\n" + para(20), para(15) + shared, "日本語 text İΣς", "x" * 3000, "aaa<|endoftext|>b", "éé" * 200]
    return out + [para(25) + "\nCommon LINE \n" + para(5) for _ in range(12)] + ["Common line" for _ in range(3)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 101, t, "en", "s", len(t or ""), 3, "x", "y", "z", "w") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def local(docs):
    return sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda x: x[0])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_the_library(name):
    path = public_tokenizers.path(name)
    own, lib, rnd = bpe.Bpe(bpe.vocabulary(path)), Tokenizer.from_file(path), random.Random(2)
    some = [t or "" for t in texts()] + ["".join(rnd.choice(a) for _ in range(rnd.randint(0, 30))) for a in ("ab ", "é \n's9", "Σς İ", " \t\x1c\xa0.") for _ in range(100)]
    for text, packed in zip(some, own.encode(some), strict=True):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert own.decode(packed) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_frames(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = bpe.decode_bpe(bpe.encode_bpe(docs, path, out="codes"), path, "codes", "back").select("text", "back").collect()
    assert len(got) == docs.count() and all((r.text or "") == r.back for r in got)
    assert bpe.encode_bpe(docs.limit(0), path, out="codes").count() == 0
    with pytest.raises(ValueError):
        bpe.encode_bpe(docs, path)  # the table has a column named ids


def test_media(spark, docs):
    store = media.store_texts(docs)
    got = {r.doc_id: r for r in media.resolve(media.parse_interleaved(store, keys=("doc_id",)), media.media_features(store)).collect()}
    for i, t in local(docs):
        raw = t.encode()
        payload = media.pad(raw)
        assert int(got[i].text) == len(raw) and got[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[i].tail_crc32 == zlib.crc32(payload[-16:]) and len(payload) % 192 == 0
    seq = media.sequence_of("<p>One <b>two</b></p><figure><img src=d1><figcaption>Cap &amp; tion</figcaption></figure><script>no</script>tail<img src=d2 alt=x>")
    assert [(x["position"], x["kind"], x["text"], x["digest"]) for x in seq] == [(0, "text", "One two", None), (1, "img", "Cap & tion", "d1"), (2, "text", "tail", None), (3, "img", "x", "d2")]
    assert media.parse_interleaved(spark.createDataFrame([(1, None), (2, "<p")], "page_id long, html string")).count() == 2


def test_urls(spark):
    made = ["http://a.example.com/en/1", "https://EXAMPLE.com/en/77?x", "http://net/de/1", "http://x.example.net/de/8#a", "http://b.org/es/", "http://notcom/en/1", "nothing", None, "http://com?q/en/", "x://y.com/en/", "ftp://é.fr/ü"]
    df = spark.createDataFrame([(i, u, "v", "h") for i, u in enumerate(made)], "page_id int, url string, verdict string, host string")
    got = {r.page_id: r for r in urls.judge_urls(df).collect()}
    assert [got[i].rule for i in range(len(made))] == ["com/en/", "example.com/en/7", "net/de/", "example.net/de/8", "org/es/", None, None, None, None, "com/en/", None]
    assert [got[i].verdict for i in (0, 1, 2, 3, 4, 9)] == ["block", "allow", "allow", "block", "block", "block"]
    assert (got[1].host, got[1].path, got[7].host, got[8].host, got[8].path) == ("example.com", "/en/77", "", "com", "")
    # the models, by a plain loop
    sym = lambda u: [urls._SYMBOLS.index(c if c in urls._SYMBOLS[1:] else "_") for c in "".join("0" if c in "123456789" else c for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in u or ""))] + [0]
    counts = {v: [Counter() for _ in range(4)] for v in ("allow", "block")}
    for i in (0, 1, 2, 3, 4, 9):
        s = sym(made[i])
        for k, c in enumerate(s):
            ctx = tuple(([0, 0, 0] + s[:k])[-3:])
            for o in range(4):
                counts[got[i].verdict][o][(*ctx[3 - o :], c)] += 1

    def prob(v, ctx, c):
        p = 1 / 32
        for o in range(4):
            k = ctx[3 - o :]
            total = sum(n for g, n in counts[v][o].items() if g[:-1] == k)
            p = (counts[v][o][(*k, c)] + 4 * p) / (total + 4)
        return p

    for i in (5, 6, 10):
        s = sym(made[i])
        want = sum(math.log(prob("allow", tuple(([0, 0, 0] + s[:k])[-3:]), c) / prob("block", tuple(([0, 0, 0] + s[:k])[-3:]), c)) for k, c in enumerate(s)) / len(s)
        assert got[i].score == pytest.approx(want, abs=1e-9)
    assert urls.judge_urls(df.limit(0)).count() == 0


def shingle_set(text, k):
    w = text.encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard(docs, k, percent):
    rows = local(docs)
    sets = {i: shingle_set(t, k) for i, t in rows}
    comp = {i: i for i, _ in rows}
    for _ in rows:
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    comp[a] = min(comp[a], comp[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(docs, k, percent).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i, _ in rows}
    assert jaccard.similar_components(docs.limit(0)).count() == 0


def test_jaccard_links_through_rows_without_an_id(spark):
    """1 and 2 are not similar, but both are to the row between them, which has no id; so are two rows without an id and 3."""
    a, b = [f"a{i}" for i in range(203)], [f"b{i}" for i in range(203)]
    middle, far = a[:180] + ["x"] * 4 + a[184:], a[:180] + ["x"] * 4 + a[184:190] + ["y"] * 4 + a[194:]
    rows = [(1, a), (None, middle), (None, middle), (2, far), (None, b), (None, b[3:]), (3, b[6:]), (None, ["alone"] * 9)]
    sets = [shingle_set(" ".join(t), 4) for _, t in rows]
    alike = lambda x, y: 100 * len(x & y) >= 90 * len(x | y)
    assert not alike(sets[0], sets[3]) and alike(sets[0], sets[1]) and alike(sets[1], sets[3])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_components(df, 4, 90).collect())
    assert got == Counter((i, len(s), c) for (i, _), s, c in zip(rows, sets, (1, 1, 1, 1, 3, 3, 3, None), strict=True))


def test_signatures_meet():
    """Any two sets within the threshold share a key on which the larger one probes."""
    rng = np.random.default_rng(1)
    for n in (2, 7, 13, 14, 40, 300):
        for _ in range(30):
            base = rng.integers(0, 1 << 63, n).astype(np.uint64)
            drop = int(rng.integers(0, max(1, int(n * 0.15)) + 1))
            a, b = np.sort(base), np.sort(base[drop:])
            if len(b) * 100 < 85 * len(a):
                continue
            owner = np.repeat([0, 1], [len(a), len(b)])
            who, key = jaccard.signatures(owner, np.concatenate([a, b]), 2, 85)
            probing = {int(x) >> 2 for x, w in zip(key, who, strict=True) if w == 0 and int(x) & 3 < 2}
            assert probing & {int(x) >> 2 for x, w in zip(key, who, strict=True) if w == 1}


def repeats(rows, length):
    seen, out = set(), {}
    for i, t in rows:
        raw = t.encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = [True] * length
            seen.add(w)
        out[i] = (len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("length", [100, 48])
def test_substrings(docs, length):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(docs, length).collect()}
    assert got == repeats(local(docs), length)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_rows_without_an_id_keep_their_own_texts(spark):
    rnd = random.Random(8)
    made = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    copy, part = made(300), made(150)
    rows = [(None, copy), (None, copy), (None, made(40) + part + made(30)), (None, made(90) + part), (None, made(200)), (None, None), (3, made(20) + part), (-7, made(400))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = sorted((r.doc_id is not None, r.doc_id or 0, r.h, r.doc_id, r.text or "") for r in df.select("*", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("h")).fillna(0, ["h"]).collect())
    want = Counter((order[i][3], n, gone, kept) for i, (n, gone, _, kept) in repeats([(i, x[4]) for i, x in enumerate(order)], 100).items())
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in substrings.remove_repeats(df, 100).collect()) == want
    full = df.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    got = Counter((r.doc_id, r.text or "") for r in corpus_pipeline.repeated_strings(spark, full, "").collect())
    assert got == Counter((i, kept.decode()) for (i, _, _, kept), n in want.items() for _ in range(n))
    with pytest.raises(ValueError):
        substrings.remove_repeats(spark.createDataFrame([(None, "a"), (-(1 << 63), "b")], "doc_id long, text string"), 100)


def test_lm(docs):
    rows = local(docs)
    train = F.col("doc_id") % 3 != 0
    got = {r.doc_id: r for r in lm.score_lm(docs, train).collect()}
    c = Counter()
    for i, t in rows:
        if i % 3:
            c.update(t.encode().lower().split())
            c[b""] += 1
    total, distinct = sum(c.values()), len(c)
    for i, t in rows:
        w = [*t.encode().lower().split(), b""]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), total)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w))
        assert got[i].score < 0
    assert lm.score_lm(docs.limit(0), train).count() == 0


def test_lm_end_is_counted_beside_many_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 4)
    words = [f"w{i}" for i in range(50)]
    df = spark.createDataFrame([(1, " ".join(words * 2)), (2, "w1 new")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_lm(df, F.col("doc_id") == 1).collect()}
    assert [(got[i].n_tokens, got[i].n_known, got[i].train_tokens) for i in (1, 2)] == [(101, 101, 101), (3, 2, 101)]
    assert got[1].base_score == pytest.approx(100 * math.log10(3 / 153) + math.log10(2 / 153))
    assert got[2].base_score == pytest.approx(math.log10(3 / 153) + math.log10(1 / 153) + math.log10(2 / 153))


def test_lm_learns_of_all_common_words_whatever_the_partitions(spark, monkeypatch):
    """Pairs beyond the WORDS most frequent words, all in one class."""
    monkeypatch.setattr(lm, "COMMON", 100, raising=False)
    monkeypatch.setattr(lm, "CHUNK", 20_000)
    monkeypatch.setattr(lm, "PER_SYMBOL", 1)
    rnd, n = random.Random(3), 30
    bag = [[f"f{i}"] for i in range(lm.WORDS) for _ in range(130)] + [[f"a{i}xx", f"b{i}xx"] for i in range(n) for _ in range(120)]
    rnd.shuffle(bag)
    rows = [(i, " ".join(w for x in bag[a : a + 50] for w in x)) for i, a in enumerate(range(0, len(bag), 50))]
    rows += [(-1 - i, f"a{i}xx b{i}xx") for i in range(n)] + [(-101 - i, f"a{i}xx b{(i + 1) % n}xx") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({r.doc_id: r.score for r in lm.score_lm(df.repartition(k), F.col("doc_id") >= 0).collect()} for k in (1, 7))
    assert one == pytest.approx(many, abs=1e-9)
    assert sum(one[-1 - i] - one[-101 - i] for i in range(n)) / n > 0.2


def test_lm_is_a_distribution():
    vocab = lm.Vocabulary(100, 5, [(lm._END, -1, 10), *((i + 1, i % lm.CLASSES, 20 - i) for i in range(6))], np.full(lm.CLASSES, 60.0))
    net = lm.LogBilinear(vocab.unigram)
    net.train(np.arange(400) % 7, np.arange(400) % 5, np.arange(400) % 3, np.random.default_rng(0))
    net.close()
    n = 1 + lm.WORDS + lm.CLASSES
    for near, far in ((0, 0), (3, 200), (500, 7)):
        assert (10 ** net.log10(np.arange(n), np.full(n, near), np.full(n, far))).sum() == pytest.approx(1, abs=1e-6)


def test_lm_sums_come_from_factors(monkeypatch):
    """The first softmax's sums of all pairs of contexts come from two rows of factors, and equal those made score by score."""
    rng = np.random.default_rng(1)
    vocab = lm.Vocabulary(1000, 900, [(lm._END, -1, 10), *((i + 1, i % lm.CLASSES, 2000 - i) for i in range(900))], np.full(lm.CLASSES, 60000.0))
    net = lm.LogBilinear(vocab.unigram)
    net.train(*rng.integers(0, net.size, (3, 5000)), rng)
    w, near, far = rng.integers(0, net.size, (3, 3000))
    widths, plain = set(), lm._log_sum
    monkeypatch.setattr(lm, "_log_sum", lambda q, table, bias: widths.add(table.shape[1]) or plain(q, table, bias))
    got = []
    for tables in (lm.TABLES, 0):
        monkeypatch.setattr(lm, "TABLES", tables)
        net.close()
        widths.clear()
        got.append(net.log10(w, near, far))
        assert (len(net.top_bias) in widths) == (tables == 0)
    assert np.abs(got[0] - got[1]).max() < 1e-6
    one = np.concatenate([net.log10(w[i : i + 1], near[i : i + 1], far[i : i + 1]) for i in range(50)])
    assert np.abs(one - got[1][:50]).max() < 1e-9


def test_lm_words_are_looked_up_together(monkeypatch):
    vocab = lm.Vocabulary(100, 9, [(lm._END, -1, 10), *((int(k), int(c), 7) for k, c in zip(lm.keys_of([b"ab", b"z"]), lm.classes_of([b"ab", b"z"]), strict=True))], np.full(lm.CLASSES, 60.0))
    texts = ["AB z new ab", None, "", "\u00e9 z \ud7ff x ab", " ".join(f"q{i}" for i in range(60)) + " new ab"]
    wide = lm._symbols(texts, lm.Memo(vocab))
    monkeypatch.setattr(lm.Memo, "most", 8)  # begun anew all the time
    for x, y in zip(wide, lm._symbols(texts, lm.Memo(vocab)), strict=True):
        assert x.tolist() == y.tolist()
    at = 0
    for text, size in zip(texts, wide[3], strict=True):
        words = (text or "").encode().lower().split()
        for i, word in enumerate([*words, None]):
            often = {b"ab": 1, b"z": 2}.get(word)
            symbol = 0 if word is None else often or 1 + vocab.words + zlib.crc32(word[-2:]) % lm.CLASSES
            key = -1 if word is None else xxhash.xxh3_64_intdigest(word) - (1 << 63)
            assert (wide[0][at + i], wide[1][at + i], wide[2][at + i]) == (symbol, key, 10 if word is None else 7 if often else -1)
        at += size
    x = np.random.default_rng(2).integers(0, 1 << 18, 5000)
    assert lm._by_number(x).tolist() == np.argsort(x, kind="stable").tolist()


def test_lines(docs):
    rows = local(docs)
    key = lambda line: line.encode().strip(b" \t\n\x0b\x0c\r").lower()
    seen = Counter(k for _, t in rows for k in {key(x) for x in t.split("\n")})
    got = {r.doc_id: r for r in lines.drop_common_lines(docs).collect()}
    for i, t in rows:
        left = [x for x in t.split("\n") if not key(x) or seen[key(x)] < 10]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept) == (t.count("\n") + 1, t.count("\n") + 1 - len(left), "\n".join(left))
    assert got[0].source == "s" and lines.drop_common_lines(docs.limit(0)).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64))
    assert sorted(lines.PerfectHash.of(keys).slots(keys).tolist()) == list(range(len(keys)))


def test_packing(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, got = Tokenizer.from_file(path), {}
    for r in packing.packed_documents(docs, path).collect():
        got.setdefault(r.doc_id, []).append(r)
    rooms = {}
    for i, t in local(docs):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        pieces = sorted(got[i], key=lambda r: r.piece)
        assert [x for r in pieces for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))] and all(r.length == 1024 for r in pieces[1:])
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in pieces)
        for r in pieces:
            rooms.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in rooms.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    sizes = sum(n for parts in rooms.values() for _, n in parts)
    assert len(rooms) <= -(-sizes // 1024) + 2
    assert packing.packed_documents(docs.limit(0), path).count() == 0
    tied = spark.createDataFrame([(i, 600) for i in range(50)], "item long, length long").repartition(4)
    assert packing.pack_best_fit(tied).select("sequence_id").distinct().count() == 50


def test_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype("f4")], 1) for i in range(300)] + [(i, [0.5] * 6, 1) for i in range(300, 330)]
    rows += [(400, None, 1), (401, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (402, [float("nan")] * 6, 1), (403, [float("inf")] * 6, 1), (404, [], 1), (405, [2.0], 1), (5, rows[5][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    fine = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    want = {(q, r, v, s) for q in fine if q % 50 == 0 for r, (s, v) in enumerate(sorted(((dot(fine[q], x), v) for v, x in fine.items() if v != q), key=lambda e: (-e[0], e[1]))[:5], 1)}
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()} == want
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df.filter("vec_id < 2"), F.lit(True)).count() == 2


def test_quality(spark, docs):
    rnd = random.Random(1)
    prose = [(i, " ".join(rnd.choice(["the", "of", "and", "river", "Stone."]) for _ in range(40)), 1) for i in range(40)]
    junk = [(100 + i, "### $$$ &&& " * rnd.randint(2, 9), 0) for i in range(20)]
    df = spark.createDataFrame(prose + junk, "doc_id long, text string, quality int")
    model = quality.fit_quality(df, df.filter("doc_id % 3 <> 1").select("doc_id", "quality"))
    got = quality.score_quality(df, model).collect()
    assert all((r.score >= 0.5) == (r.quality == 1) for r in got)
    odd = quality.score_quality(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    none = quality.fit_quality(df, df.limit(0))
    assert {r.score for r in quality.score_quality(df, none).collect()} == {0.5}


def test_shingle_hashes_tell_texts_apart():
    owner, values = hashing.shingles([b"a b c d e", b"A  b\tc d e", b"a b c d f", b"a b", b"", b" b a "], 4)
    rows = [set(values[owner == i].tolist()) for i in range(6)]
    assert rows[0] == rows[1] and len(rows[0] & rows[2]) == 1 and len(rows[3]) == 1 and not rows[4] and rows[5] != rows[3]
