"""Spelling variants: words one edit apart, found with forward and backward automata.

If two words differ by one inserted, deleted or replaced code point, the difference lies in
one half of the first word, and the other half is in both. So each word's first half
is followed exactly in a minimal acyclic automaton of all words and the rest is completed with one
error; its second half is followed in the automaton of the reversed words likewise. Both
automata number their words (a perfect hash: each edge knows how many words come before it), so a path's end is a
place in an array of words and counts. What the forward automaton finds begins with the first half; the
backward one leaves those out, so no pair comes twice.

The automata are distributed: a word stands under each first half by which a word of its own, the next
shorter or the next longer length can ask for it (and likewise each second half), and shards of such
halves have automata of their own. A half with more than BLOCK words is dealt to blocks by the words' hashes, and
its askers go to every block: for a half with w words that makes w / BLOCK rows an asker.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialize, table

#: Words under one half that are kept together, and words of a shard.
BLOCK, SHARD = 16_000, 16_000
#: Distinct words that a counting task holds.
HELD = 200_000
_RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")


def _count(least: int, drop_every: int | None):
    """(word, n) over texts: runs of letters of at least ``least`` code points, after the deletions."""
    def run(batches):
        total: Counter = Counter()

        def counted():
            words = [w.decode() for w in total]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, name in enumerate(ids):
                text = texts[i].as_py()
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if name is None else name}:".encode())
                for word, n in Counter(_RUN.findall(text.encode().lower())).items():
                    if len(word) < least:
                        continue
                    if drop_every and not (h := zlib.crc32(word, seed)) % drop_every:
                        s = word.decode()
                        at = h % len(s)
                        word = (s[:at] + s[at + 1 :]).encode()
                    if len(word) >= 2 * least or len(word) - word.count(b"\xc3") >= least:
                        total[word] += n
                if len(total) > HELD:
                    yield counted()
                    total.clear()
        if total:
            yield counted()

    return run


class Automaton:
    """The minimal acyclic automaton of distinct words given in order, with word numbers.

    ``edges[s][c]`` is (next state, words that come before those of this edge); ``final[s]`` tells whether a word ends at s.
    """

    def __init__(self, words):
        self.edges: list[dict] = [{}]
        self.final, self.count = [False], [0]
        known: dict = {}
        path, last = [0], ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._close(path, last, same, known)
            for c in word[same:]:
                self.edges.append({})
                self.final.append(False)
                self.count.append(0)
                self.edges[path[-1]][c] = (len(self.edges) - 1, 0)
                path.append(len(self.edges) - 1)
            self.final[path[-1]] = True
            last = word
        self._close(path, last, 0, known)
        self._number(0)

    def _number(self, s: int) -> None:
        n = int(self.final[s])
        for c, (t, _) in self.edges[s].items():
            self.edges[s][c] = (t, n)
            n += self.count[t]
        self.count[s] = n

    def _close(self, path: list[int], last: str, upto: int, known: dict) -> None:
        """States of the last word past ``upto`` change no more: number them, and share equal ones."""
        while len(path) > upto + 1:
            s = path.pop()
            self._number(s)
            kept = known.setdefault((self.final[s], tuple((c, t) for c, (t, _) in self.edges[s].items())), s)
            if kept != s:
                self.edges[path[-1]][last[len(path) - 1]] = (kept, 0)
                if s == len(self.edges) - 1:
                    for held in (self.edges, self.final, self.count):
                        held.pop()

    def follow(self, s: int, k: int, text: str, start: int = 0):
        """State and number after ``text`` from ``start``; None where no path is."""
        edges = self.edges
        for c in text[start:] if start else text:
            e = edges[s].get(c)
            if e is None:
                return None
            s, k = e[0], k + e[1]
        return s, k

    def one_error(self, head: str, tail: str) -> set[int]:
        """Numbers of the words that begin with ``head`` and go on with ``tail`` but for exactly one edit."""
        out: set[int] = set()
        at = self.follow(0, 0, head)
        if at is None:
            return out
        s, k = at

        def rest(s, k, i):
            end = self.follow(s, k, tail, i)
            if end is not None and self.final[end[0]]:
                out.add(end[1])

        for i in range(len(tail) + 1):
            here = tail[i] if i < len(tail) else None
            for c, (t, n) in self.edges[s].items():
                rest(t, k + n, i)
                if here is not None and c != here:
                    rest(t, k + n, i + 1)
            if here is None:
                break
            rest(s, k, i + 1)
            e = self.edges[s].get(here)
            if e is None:
                break
            s, k = e[0], k + e[1]
        # an inserted code point beside its equal gives the same word from two places; the set holds it once
        return out


def _search(batches):
    """(word, n_near, form, form_n) of each asker among the words of its shard."""
    at = automaton = None
    forms, counts = [], []
    for batch in batches:
        shard, back, kind, form, n, block, blocks = (batch.column(i).to_pylist() for i in range(7))
        out = []
        for i in range(len(form)):
            if (shard[i], back[i]) != at:
                at, automaton, forms, counts = (shard[i], back[i]), None, [], []
            w = form[i]
            if kind[i] == 0:
                if not forms or forms[-1] != w:  # a word can stand under several halves of one shard
                    forms.append(w)
                    counts.append(n[i])
                continue
            if automaton is None:
                automaton = Automaton(forms)
            # the first half of the word is shorter by one if the length is odd
            cut = len(w) - len(w) // 2 if back[i] else len(w) // 2
            found = [(counts[j], forms[j]) for j in automaton.one_error(w[:cut], w[cut:])]
            if back[i]:
                own = w[cut:]
                found = [(c, b) for c, b in found if not b.endswith(own)]
                found = [(c, b[::-1]) for c, b in found]
            if blocks[i] > 1:
                found = [(c, b) for c, b in found if zlib.crc32(b.encode()) % blocks[i] == block[i]]
            if found:
                c, b = min((-c, b) for c, b in found)
                out.append((w[::-1] if back[i] else w, len(found), b, -c))
        if out:
            word, near, best, of = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.int64()), pa.array(best, pa.string()), pa.array(of, pa.int64())], names=["word", "n_near", "form", "form_n"])


def near_words(words: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(word, n_near, form, form_n) for the words that have others one edit away, from distinct (word, n) with n >= 0.

    ``form`` is the near word of largest n, ties to the smallest in code-point order. Nulls and empty words are passed over.
    """
    spark = words.sparkSession
    words = words.filter("word <> ''")
    size = F.char_length("word")
    halves = lambda back: F.array_distinct(F.array(*(F.expr(f"{'n_ - div(n_, 2)' if back else 'div(n_, 2)'}".replace("n_", f"(char_length(word) + {d})")).cast("int") for d in (-1, 0, 1))))
    cut = F.when(F.col("back"), size - F.floor(size / 2)).otherwise(F.floor(size / 2)).cast("int")
    both = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    form = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    key = lambda n: F.concat(F.when(F.col("back"), "<").otherwise(">"), F.substring(F.col("form"), F.lit(1), n))
    # a half longer than the word itself is not asked for by any word one edit away
    stand = both.withColumn("form", form).withColumn("h", F.explode(F.when(F.col("back"), halves(True)).otherwise(halves(False)))).filter(F.col("h") <= size)
    stand = stand.select("back", F.lit(0).alias("kind"), "form", "n", key(F.col("h")).alias("key"), F.crc32(F.col("word").cast("binary")).alias("crc"))
    ask = both.withColumn("form", form).select("back", F.lit(1).alias("kind"), "form", "n", key(cut).alias("key"), F.lit(0).cast("long").alias("crc"))
    stand = materialize(stand, "halves")
    total = stand.count()
    shards = max(1, -(-total // shard))
    large = materialize(stand.groupBy("key").count().filter(F.col("count") > block).select(F.col("key").alias("__k"), F.ceil(F.col("count") / block).cast("int").alias("__b")), "large")
    rows = stand.unionByName(ask).join(large, F.col("key") == F.col("__k"), "left").withColumn("blocks", F.coalesce("__b", F.lit(1)))
    blocks = F.when(F.col("kind") == 0, F.array((F.col("crc") % F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("block", F.explode(blocks)).select(F.pmod(F.xxhash64("key", "block"), F.lit(shards)).cast("int").alias("shard"), "back", "kind", "form", "n", "block", "blocks")
    parts = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = in_arrow(dealt.repartition(parts, "shard").sortWithinPartitions("shard", "back", "kind", "form"), _search, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form", (-F.col("b.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following (word, form) to the end; each round doubles the steps. Forms must not run in circles."""
    now = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.filter("moved").isEmpty():
        on = now.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        now = now.join(on, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved"))
        now = materialize(now, "roots")
    return now.select("word", "root")


def word_counts(docs: DataFrame, least_length: int = 5, drop_every: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): lower-cased (A-Z) runs of Latin letters of at least ``least_length`` code points, and their occurrences.

    Null and empty texts have none. ``drop_every``: where it divides the crc32 of ``<doc_id>:<run>`` (null id: empty), the run loses
    the code point at that crc32 modulo its length first.
    """
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    return in_arrow(rows, _count(least_length, drop_every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spelling_variants(docs: DataFrame, least_n: int = 3, factor: int = 2, block: int = BLOCK, shard: int = SHARD, **of) -> DataFrame:
    """One row per word with at least ``least_n`` occurrences: word, form, root, n, n_near, form_n.

    Words are those of ``word_counts`` (which takes ``of``). Two are near if one inserted, deleted or replaced code point
    makes one of the other. ``form`` is the near word of largest n (ties: smallest in code-point order) if that is at least ``factor``
    times (2 or more) the word's n, else null, as is ``form_n``; ``root`` follows forms to the last. Repeated rows count each; other columns
    of ``docs`` are passed over, whatever their names; an empty table gives an empty table. Very long runs are words like others.
    """
    words = materialize(word_counts(docs, **of).filter(F.col("n") >= least_n), "words")
    near = near_words(words, block, shard).withColumnsRenamed({"word": "__w", "form": "__f", "form_n": "__n"})
    is_form = F.col("__n") >= factor * F.col("n")
    rows = words.join(near, F.col("word") == F.col("__w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("__f")).alias("form"), F.when(is_form, F.col("__n")).alias("form_n")
    )
    rows = materialize(rows, "variants")
    ends = roots(rows.filter("form IS NOT NULL")).withColumnRenamed("word", "__w")
    return rows.join(ends, F.col("word") == F.col("__w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of the documents, with every 97th (document, word) misspelt."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants(docs, drop_every=97)


QUERIES = {"op12_spelling": op12_spelling}
ORACLES: dict[str, str] = {}
