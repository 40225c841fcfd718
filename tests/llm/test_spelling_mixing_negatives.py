"""Hard negatives, spelling variants and mixing against plain Python, on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, negatives, spelling, substrings

# --- hard negatives ---------------------------------------------------------


def plain_negatives(rows, positives, least, k):
    fine = {}
    for i, vec, label in rows:
        if i is None or label is None or vec is None or any(x is None or x != x or abs(x) == float("inf") for x in vec):
            continue
        row = (label, tuple(int((256 * x) // 1) for x in vec))
        fine[i] = min(fine.get(i, row), row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for a in fine:
        if a % least:
            continue
        label, vec = fine[a]
        scored = sorted((-dot(vec, v), i, l == label) for i, (l, v) in fine.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            inside = [(t, i) for t, i, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s]
            out |= {(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(inside[:k])}
    return out


def embeddings(n, seed, copies=0):
    rnd = random.Random(seed)
    vec = lambda: [rnd.gauss(0.3, 1) for _ in range(6)]
    rows = [(i, vec(), rnd.randrange(3)) for i in range(n)]
    rows += [(10_000 + i, [1.0] * 6, i % 2) for i in range(copies)]
    return rows


@pytest.mark.parametrize("block", [64, 8192])
def test_hard_negatives(spark, block):
    odd = [(None, [1.0] * 6, 1), (3000, None, 1), (3001, [1.0, None], 1), (3002, [float("nan")], 1), (3003, [float("inf")], 2), (3004, [1.0] * 6, None), (3100, [], 1), (3200, [2.0], 0), (0, [9.0] * 6, 9), (-500, [0.5] * 6, 1), (3300, [1e30, -1e30], 1)]
    rows = embeddings(300, 1, copies=150)[1:] + [(0, [0.4] * 6, 1)] + odd + [(200, [5.0] * 6, 2)] * 2
    rows = [r for r in rows if not (r[1] and abs(r[1][0] or 0) > 1e20)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "vec_id long, embedding array<double>, label int, rank string, anchor string, score string").repartition(5)
    got = [tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_negatives(rows, 5, 100, 10)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_hard_negatives_of_huge_components_do_not_fail(spark):
    df = spark.createDataFrame([(0, [1e200, 1e200], 1), (1, [1e300, -1e200], 1), (2, [3e14, 1.0], 2), (-(1 << 63), [1e300], 2), ((1 << 63) - 1, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert negatives.hard_negatives(df, F.col("vec_id") == 0).count() >= 0


def test_more_ties_than_any_window_holds(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(0, 400, 100)] + [(1000 + i, [0.5, float(i % 2)], 1) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {tuple(r) for r in negatives.hard_negatives(df, (F.col("vec_id") % 100 == 0) & (F.col("vec_id") < 400), block=100).collect()}
    anchors = [r for r in plain_negatives(rows, 5, 100, 10) if r[0] < 400]
    assert got == set(anchors) and len(got) == 4 * 3 * 10


# --- spelling ----------------------------------------------------------------


def plain_counts(rows, every):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    out, form = [], {}
    for w, n in words.items():
        around = sorted((-m, v) for v, m in words.items() if near(w, v))
        if around and -around[0][0] >= 2 * n:
            form[w] = around[0][1]
        out.append((w, n, len(around)))
    rows = set()
    for w, n, k in out:
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, n, k, words[form[w]] if w in form else None))
    return rows


def letters(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(4, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "ababab", "Größe", "straße", "NAÏVE", "xÉÉÉÉ"]
    texts = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = rnd.choice(base[: 1 + i % len(base)])
            if rnd.random() < 0.3:
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + rnd.choice("abc") + w[at:], w[:at] + rnd.choice("abc") + w[at + 1 :]])
            words.append(rnd.choice([w, w.upper(), w]))
        texts.append(rnd.choice([" ", "-", "1", "\n", "×", "日"]).join(words))
    return texts


@pytest.mark.parametrize(("block", "shard"), [(16_000, 16_000), (7, 50)])
def test_spelling(spark, block, shard):
    rows = [(i // 2, t) for i, t in enumerate(letters(3))] + [(None, None), (7, None), (8, ""), (None, letters(4)[0]), (9, "q" * 5000 + " " + "q" * 4999), (10, ("q" * 5000 + " ") * 3 + ("q" * 4999 + " ") * 8)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "doc_id long, text string, word string, form string, n string").repartition(4)
    got = [tuple(r) for r in spelling.spelling_variants(df, block=block, shard=shard, drop_every=7).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = plain_variants(plain_counts(rows, 7))
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r[1] is not None for r in want) > 10 and sum(r[1] is not None and r[1] != r[2] for r in want) > 3
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_automaton_numbers_are_places():
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 8))) for _ in range(150)})
    a = spelling.Automaton(words)
    for i, w in enumerate(words):
        s, k = a.follow(0, 0, w)
        assert a.final[s] and k == i
        assert {words[j] for j in a.one_error("", w)} == {v for v in words if near(w, v)}
    # minimal: no two states have the same ways on
    seen = {(a.final[s], tuple((c, t) for c, (t, _) in a.edges[s].items())) for s in reach(a)}
    assert len(seen) == len(reach(a))
    assert spelling.Automaton([]).one_error("", "a") == set()


def reach(a):
    found, todo = {0}, [0]
    while todo:
        for t, _ in a.edges[todo.pop()].values():
            if t not in found:
                found.add(t)
                todo.append(t)
    return found


# --- mixing ------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, goal, free = sum(sizes.values()), {}, set(names)
    while free:
        left, heavy = total - sum(goal.values()), sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / heavy > most * sizes[s]}
        if not above:
            goal |= {s: left * weight[s] / heavy for s in free}
            break
        goal |= {s: most * sizes[s] for s in above}
        free -= above
    return goal


def mixed_docs(seed, spread):
    rnd = random.Random(seed)
    rows = []
    for i in range(900):
        source = rnd.choice(["hot"] * 6 + ["a", "b", "é", None, "tiny", "c"])
        if source == "tiny" and rnd.random() < 0.8:
            continue
        rows.append((i % 880, None if i % 90 == 7 else "w\x1fw " * rnd.choice(spread) + rnd.choice(["", " \t", "日本"]), source))
    return rows + [(1, "", "empty"), (2, None, "empty"), (None, "one two", "a"), (None, "one two", "a")]


@pytest.mark.parametrize("spread", [(0, 1, 5, 40), (3,), range(1, 200)])
def test_mixing(spark, spread):
    rows = mixed_docs(2, spread)
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, source string, place string, copies int").repartition(7)
    frame = mixing.mix_sources(df)
    got = [tuple(r) for r in frame.select("doc_id", "size", "source_size", "target", "copies", "taken").collect()]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    goal = plain_targets(sizes)
    assert len(got) == len(rows)
    # the plain way, by one sorted list for each source
    want = Counter()
    for s in sizes:
        own = sorted(((words(t), hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i is not None, i) for i, t, o in rows if o == s), key=lambda x: x[:3] + (x[3] or 0,))
        step = int(goal[s] / sizes[s] * mixing.UNIT) if sizes[s] else 0
        shift = int(hashlib.md5(f"13:{s or ''}".encode()).hexdigest()[:8], 16) * mixing.UNIT >> 32
        taken = 0
        for place, (n, _, _, i) in enumerate(own):
            copies = ((place + 1) * step + shift) // mixing.UNIT - (place * step + shift) // mixing.UNIT
            assert copies <= 3
            taken += copies * n
            want[i, n, sizes[s], round(goal[s], 6), copies, copies * n] += 1
        assert abs(taken - goal[s]) <= max((x[0] for x in own), default=0) + 1e-6
    assert Counter((i, n, z, round(g, 6), c, t) for i, n, z, g, c, t in got) == want
    again = [tuple(r) for r in mixing.mix_sources(df.repartition(2)).select("doc_id", "size", "source_size", "target", "copies", "taken").collect()]
    assert Counter(again) == Counter(got)


def test_mix_is_emitted(spark):
    df = spark.createDataFrame(mixed_docs(3, (1, 2, 9)), "doc_id long, text string, source string")
    frame = mixing.mix_sources(df, carry=("text",))
    assert mixing.emit(frame).count() == frame.agg(F.sum("copies")).first()[0]
    assert mixing.emit(frame).filter(F.col("copy") > 3).count() == 0
    assert mixing.mix_sources(df.limit(0)).count() == 0
    blank = mixing.mix_sources(df.withColumn("text", F.lit(None).cast("string")))
    assert blank.agg(F.sum("taken"), F.sum("target")).first() == (0, 0.0)


# --- repeated strings of rows that share an id --------------------------------


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    a, other = text(150), text(400)
    rows = [(1, a), (2, "x" + a + "y"), (2, other), (3, a), (None, text(200)), (4, None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, __doc string").repartition(3)
    got = substrings.remove_repeats(df, 100).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    # rows of a repeated id come first, so theirs is the copy that stays, and nothing else is cut
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == [(0, 200, 0), (1, 150, 150), (2, 152, 0), (2, 400, 0), (3, 150, 150), (4, 0, 0)]
