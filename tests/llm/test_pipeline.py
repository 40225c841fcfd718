"""The pipeline's stages and its run against plain Python, on odd rows: nulls, copies, repeated ids, ties, an empty table."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm import repeats, shingle_set
from tokenizers import Tokenizer

from ledgerloom.llm import graph, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __key string, kept string, score string"


def made_rows():
    """(doc_id, text, label): prose with copies, near copies, common lines and shared passages, and junk."""
    rnd = random.Random(11)
    words = ["the", "of", "river", "stone", "and", "winter", "a", "letter", "was", "brought", "over", "hill", "in", "morning", "light"]
    prose = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "", "s", "ed"]) for _ in range(n)) + "."
    out = [prose(rnd.randint(30, 90)) for _ in range(20)]
    base, passage = prose(80), prose(40)
    near = base.split()
    near[40] = "changed"
    out += [base, base, " ".join(near), base + " end", prose(30) + " " + passage, prose(20) + " " + passage + " " + prose(9)]
    out += [prose(25) + "\n  Read More Here\t\n" + prose(20) for _ in range(12)]
    junk = ["### $$$ &&& @@ " * rnd.randint(3, 12) for _ in range(12)]
    return [(10 + 3 * i, t, 1) for i, t in enumerate(out)] + [(500 + i, t, 0) for i, t in enumerate(junk)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"r{k}", len(t or ""), "k", "x", "y") for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path, rows = str(tmp_path_factory.mktemp("corpus")), made_rows()
    frame(spark, [(i, t) for i, t, _ in rows]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def good_texts(spark, path, docs, texts):
    model = quality.fit_quality(docs, spark.read.parquet(f"{path}/labels.parquet"))
    return [float(model.score(quality.features([t]))[0]) >= 0.5 for t in texts]


def without_lines(texts):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    return ["\n".join(x for x in (t or "").split("\n") if not key(x) or seen[key(x)] < 10) for t in texts]


def groups(texts):
    sets = [shingle_set(t or "", 5) for t in texts]
    comp = list(range(len(sets)))
    for _ in sets:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


def test_run(spark, made):
    path, rows = made
    keep = [(i, t) for (i, t, _), ok in zip(rows, good_texts(spark, path, spark.read.parquet(f"{path}/documents.parquet"), [t for _, t, _ in rows]), strict=True) if ok]
    assert {i for i, _ in keep} == {i for i, _, y in rows if y}
    keep = [(i, t) for (i, _), t in zip(keep, without_lines([t for _, t in keep]), strict=True)]
    comp = groups([t for _, t in keep])  # ids ascend, so the first of a group is its smallest
    keep = [keep[k] for k in sorted(set(comp))]
    kept = {i: kept.decode() for i, (_, _, _, kept) in repeats(keep, 100).items()}
    assert len(kept) == len(keep) < 36 and any(len(kept[i]) < len(t) for i, t in keep)
    lib, got, bins = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}, {}
    for r in corpus_pipeline.run(spark, path).collect():
        got.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(got) == set(kept)
    for i, t in kept.items():
        ids, at = [*lib.encode(t, add_special_tokens=False).ids, 2], 0
        for r in sorted(got[i], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
    assert len(bins) <= -(-sum(n for parts in bins.values() for _, n in parts) // 1024) + 1


def test_stages_on_odd_rows(spark, made):
    path, rows = made
    texts = [t for _, t, _ in rows]
    odd = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, None), (10, texts[2]), (10, texts[2]), (10, texts[3]), (8, ""), (9, None), (1, texts[0]), (2, texts[2]), (500, texts[-1]), (None, texts[-1])]
    odd += [(100 + k, texts[30]) for k in range(9)] + [(None, texts[30])]
    df = frame(spark, odd)
    told = lambda d: {r.source: (r.doc_id, r.text) for r in d.collect()}
    ok = good_texts(spark, path, df, [t for _, t in odd])
    assert 0 < sum(ok) < len(ok)
    assert told(corpus_pipeline.quality(spark, df, path)) == {f"r{k}": x for k, x in enumerate(odd) if ok[k]}
    assert told(corpus_pipeline.line_dedup(spark, df, path)) == {f"r{k}": (i, t) for k, ((i, _), t) in enumerate(zip(odd, without_lines([t for _, t in odd]), strict=True))}
    left = told(corpus_pipeline.near_duplicates(spark, df, path))
    comp, often = groups([t for _, t in odd]), Counter(i for i, _ in odd)
    for c in set(comp):
        mine = [k for k, x in enumerate(comp) if x == c]
        stay = [k for k in mine if f"r{k}" in left]
        assert len(stay) == 1
        first = [k for k in mine if odd[k][0] is None or often[odd[k][0]] > 1]  # these come before all others
        assert stay[0] in first if first else odd[stay[0]][0] == min(odd[k][0] for k in mine)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, path)
        assert name == "packing" or tuple(out.columns) == COLUMNS
        assert stage(spark, df.limit(0), path).count() == 0
    pieces = corpus_pipeline.packing(spark, df, path).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == dict(often)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(30)] + [(i, 300) for i in range(301, 320)] + [(None, 4), (5, 5)]
    comp = {v: v for e in edges if None not in e and e[0] != e[1] for v in e}
    for _ in comp:
        for a, b in edges:
            if a in comp and b in comp:
                comp[a] = comp[b] = min(comp[a], comp[b])
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.v: r.comp for r in graph.components(df).collect()} == comp
    assert graph.components(df.limit(0)).count() == 0
    stars = spark.createDataFrame([(v, c) for v, c in comp.items()], "a long, b long")
    assert {r.v: r.comp for r in graph.components(stars).collect()} == comp
