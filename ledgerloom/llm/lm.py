"""A log-bilinear language model trained in numpy with noise-contrastive estimation.

Symbols are all words that occur at least ``common(tokens)`` times (the WORDS most frequent ones in
any case), the text's end, and classes of all rarer words (by their last two bytes,
so that a class tells of language and form). The bound grows with the root of the corpus, so the
number of symbols grows with the corpus too, about as fast as the root.
The two symbols before a word predict its symbol: each has a context vector,
their sum times the word's vector plus its bias is the score. The softmax is
factored: the most frequent symbols and groups of the others first, then the
symbols of a group. A word that stands for itself has its symbol's probability;
any other word has its class's probability times its own share of the class,
(c + 1) over the class's sum, so that the model is a distribution over all words and
one unseen word per class.

Counts come from all training rows. Training rows are dealt by a hash of id and text to
chunks of about CHUNK tokens (more for a large vocabulary), and chunks to rounds, as many as the number of chunks has binary digits.
A round trains on its chunks at the same time, each from the same start, and takes the mean of each vector over
the chunks that changed it; the next round starts there. So all rows are trained on once, in an
order that neither files nor partitions change, and more input means more and larger rounds.
"""

from __future__ import annotations

import copy
import uuid
import zlib
from array import array
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_class, in_arrow, materialize, sliced, table

#: Words that are symbols of their own at least, classes of the others, numbers in a vector.
WORDS, CLASSES, SIZE = 447, 64, 16
#: Occurrences that make any word a symbol of its own, in up to COMMON_OF tokens.
COMMON, COMMON_OF = 200, 10_000_000
#: Symbols that the first softmax tells apart; the others are in groups.
HEAD = 128
#: Tokens of a chunk at least, and for each symbol; rows of parameters that are averaged together.
CHUNK, PER_SYMBOL, BLOCK = 4_000_000, 100, 8192
#: Tokens of a chunk that are shuffled together; rows that are scored together.
RUN, LINES = 500_000, 256
#: Bytes that tables of factors may take in a process; how far apart logs may lie that are factors in single precision.
TABLES, SPREAD = 192 << 20, 80.0
#: Words whose counts go to every task; the others' are looked up in shards.
FREQUENT = 1 << 16
SHARD_WORDS, SHARD_TOKENS = 250_000, 5_000_000
_END = -1  # the end's key; words have others


def common(tokens: int) -> int:
    """Occurrences that make any word a symbol of its own in a corpus of so many tokens."""
    return int(COMMON * max(1.0, tokens / COMMON_OF) ** 0.5)


def keys_of(words: list[bytes]) -> np.ndarray:
    """Words' 64-bit keys, as signed numbers. Two words of a corpus share one with a chance below 1e-6 up to 10^6 words."""
    k = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64) ^ np.uint64(1 << 63)
    k = k.view(np.int64)
    k[k == _END] = 0
    return k


@lru_cache(1)
def _class_table() -> np.ndarray:
    """Classes of all pairs of bytes, then of single bytes."""
    ends = [bytes((a, b)) for a in range(256) for b in range(256)] + [bytes((a,)) for a in range(256)]
    return np.array([zlib.crc32(x) % CLASSES for x in ends], np.int64)


def classes_of(words: list[bytes]) -> np.ndarray:
    """Words' classes: by their last two bytes."""
    if not words:
        return np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    text, ends = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum(sizes)
    return _class_table()[np.where(sizes > 1, text[ends - 2] << 8, 1 << 16) + text[ends - 1]]


def _lengths(texts) -> list:
    return [range(n or 0) for n in pa.compute.binary_length(texts).to_pylist()]


def _count(batches):
    """Counts of each batch's words and ends: key, class, n."""
    for batch in batches:
        texts = batch.column(0)
        for a, b in sliced(_lengths(texts), 2 << 20):
            seen: Counter = Counter()
            for t in texts.slice(a, b - a).to_pylist():
                seen.update((t or "").encode("utf-8", "replace").lower().split())
            words = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keys_of(words), _END)), pa.array(np.append(classes_of(words), -1).astype(np.int32)), pa.array([*seen.values(), b - a], pa.int64())], names=["key", "cls", "n"])


class LogBilinear:
    """Parameters, one row each: context vectors of the last and of the last but one symbol, vectors and
    biases of symbols, then of groups. Symbols beyond the HEAD most frequent lie in groups of
    neighbours by frequency, about as many groups as symbols in a group."""

    def __init__(self, unigram: np.ndarray, seed: int = 11):
        n = self.size = len(unigram)
        order = np.argsort(-unigram, kind="stable")
        head, self.tail = order[:HEAD], order[HEAD:]
        k = int(np.ceil(np.sqrt(len(self.tail) / 2)))
        self.starts = np.arange(k + 1) * len(self.tail) // max(1, k)  # groups are runs of the tail
        group = np.repeat(np.arange(k), np.diff(self.starts))
        self.place = np.empty(n, np.int64)  # a symbol's place in the tail, or -1
        self.place[head], self.place[self.tail] = -1, np.arange(len(self.tail))
        self.first = np.empty(n, np.int64)  # what stands for a symbol in the first softmax
        self.first[head], self.first[self.tail] = np.arange(len(head)), len(head) + group
        self.rows = np.concatenate([2 * n + head, 3 * n + np.arange(k)]), 2 * n + self.tail
        rest = unigram[self.tail]
        self.noise = np.concatenate([unigram[head], np.bincount(group, rest, k)]), rest / max(rest.sum(), 1e-300)
        rng = np.random.default_rng(seed)
        self.params = np.zeros((3 * n + k, SIZE + 1), np.float32)
        self.params[:, :SIZE] = rng.standard_normal((3 * n + k, SIZE)) * 0.05
        for rows, p in zip(self.rows, self.noise, strict=True):
            self.params[rows, SIZE] = np.log(p)
        self.sums = np.full((3 * n + k, 2), 1e-5, np.float32)  # of squared gradients: vector, bias
        self.times = np.zeros(3 * n + k, np.float32)  # how often a row was changed

    def train(self, w: np.ndarray, near: np.ndarray, far: np.ndarray, rng, noise: int = 32, batch: int = 4096, rate: float = 0.15) -> None:
        """One pass over positions: symbols and the two before them. NCE of both softmaxes with ``noise`` draws shared by a batch."""
        levels = [(rows, np.log(noise * p).astype(np.float32), np.cumsum(p)) for rows, p in zip(self.rows, self.noise, strict=True)]
        order = rng.permutation(len(w))
        for at in range(0, len(w), batch):
            i = order[at : at + batch]
            wi, ni, fi = w[i], near[i], self.size + far[i]
            q = self.params[ni, :SIZE] + self.params[fi, :SIZE]
            dq = np.zeros((len(i), SIZE + 1), np.float32)
            place = self.place[wi]
            deep = np.flatnonzero(place >= 0)
            changes = []
            for (rows, shift, cdf), to, at_ in zip(levels, (self.first[wi], place[deep]), (slice(None), deep), strict=True):
                if not len(to):
                    continue
                drawn = np.minimum(np.searchsorted(cdf, rng.random(noise) * cdf[-1]), len(rows) - 1)
                own, qs, true, other = rows[to], q[at_], self.params[rows[to]], self.params[rows[drawn]]
                score = np.einsum("ij,ij->i", qs, true[:, :SIZE]) + true[:, SIZE] - shift[to]
                against = qs @ other[:, :SIZE].T + (other[:, SIZE] - shift[drawn])
                up = 1 / (1 + np.exp(np.clip(score, -30, 30))) / len(i)
                down = np.exp(np.clip(np.negative(against, out=against), -30, 30, out=against), out=against)
                down += 1
                np.divide(-1, down, out=down)
                down /= len(i)
                dq[at_, :SIZE] += up[:, None] * true[:, :SIZE] + down @ other[:, :SIZE]
                changes += [(own, np.concatenate([up[:, None] * qs, up[:, None]], 1)), (rows[drawn], np.concatenate([down.T @ qs, down.sum(0)[:, None]], 1))]
            self._change(*(np.concatenate(x) for x in zip((ni, dq), (fi, dq), *changes, strict=True)), rate)

    def _change(self, rows: np.ndarray, values: np.ndarray, rate: float) -> None:
        order = _by_number(rows)
        rows = rows[order]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        rows, g = rows[starts], np.add.reduceat(values[order], starts, axis=0) * 50
        self.times[rows] += 1
        s = self.sums[rows] + np.stack([(g[:, :SIZE] ** 2).mean(1), g[:, SIZE] ** 2], 1)
        self.sums[rows] = s
        root = rate / np.sqrt(s)
        g[:, :SIZE] *= root[:, :1]
        g[:, SIZE] *= root[:, 1]
        self.params[rows] += g

    def close(self) -> None:
        """The tables that scoring reads."""
        self.top, self.deep = (np.ascontiguousarray(self.params[rows, :SIZE].T.astype(np.float64)) for rows in self.rows)
        self.top_bias, self.deep_bias = (self.params[rows, SIZE].astype(np.float64) for rows in self.rows)
        self.opened = None

    def _open(self):
        """What a process makes of these tables, once: contexts, and vectors and biases of both softmaxes, as rows; and the factors of
        the first softmax's sums. exp(a + b) is exp(a) exp(b), so each context has a row of factors and a pair's sum is a product of
        two rows. None, if factors would take too much memory or lie too far apart for single precision."""
        if self.opened is None:
            near, far = (np.ascontiguousarray(self.params[a : a + self.size, :SIZE]) for a in (0, self.size))
            vectors = [(np.ascontiguousarray(t.T), b) for t, b in ((self.top, self.top_bias), (self.deep, self.deep_bias))]
            factors = None
            if 8 * self.size * len(self.top_bias) <= TABLES:
                factors = [_factors(near, self.top, 0.0), _factors(far, self.top, self.top_bias)]
                if min(f[2] for f in factors) > SPREAD:
                    factors = None
            self.opened = near, far, vectors, factors
        return self.opened

    def _norms(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Logs of the first softmax's sums after pairs of contexts."""
        n, f, _, factors = self._open()
        out = np.empty(len(near))
        for a in range(0, len(near), LINES):
            i, j = near[a : a + LINES], far[a : a + LINES]
            if factors is None:
                out[a : a + LINES] = _log_sum((n[i] + f[j]).astype(np.float64), self.top, self.top_bias)
            else:
                (x, up, _), (y, more, _) = factors
                z = x[i]
                z *= y[j]
                out[a : a + LINES] = np.log(z.sum(1, dtype=np.float64)) + up[i] + more[j]
        return out

    def log10(self, w: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of symbols after their contexts."""
        if not len(w):
            return np.zeros(0)
        n, f, ((top, top_bias), (rest, rest_bias)), _ = self._open()
        pairs = near * self.size + far
        order = np.argsort(pairs)  # equal contexts side by side
        w, near, far, pairs = w[order], near[order], far[order], pairs[order]
        fresh = np.concatenate([[True], pairs[1:] != pairs[:-1]])
        starts = np.flatnonzero(fresh)
        out = -self._norms(near[starts], far[starts])[np.cumsum(fresh) - 1]
        q, to, place = np.empty((len(w), SIZE), np.float32), self.first[w], self.place[w]
        for a in range(0, len(w), 16 * LINES):
            part = slice(a, a + 16 * LINES)
            q[part] = n[near[part]] + f[far[part]]
            out[part] += np.einsum("ij,ij->i", q[part].astype(np.float64), top[to[part]]) + top_bias[to[part]]
        deep = np.flatnonzero(place >= 0)
        group = to[deep] - len(top_bias) + len(self.starts) - 1
        sort = _by_number(group)
        deep = deep[sort]
        cuts = np.searchsorted(group[sort], np.arange(len(self.starts)))
        for k in np.flatnonzero(np.diff(cuts)):
            a, b = self.starts[k], self.starts[k + 1]
            table, bias = np.ascontiguousarray(self.deep[:, a:b]), self.deep_bias[a:b]
            for i in range(cuts[k], cuts[k + 1], LINES):
                j = deep[i : min(i + LINES, cuts[k + 1])]
                context, own = q[j].astype(np.float64), place[j]
                out[j] += np.einsum("ij,ij->i", context, rest[own]) + rest_bias[own] - _log_sum(context, table, bias)
        back = np.empty(len(w))
        back[order] = out
        return back / np.log(10)


def _by_number(x: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0 to 2^32: by 16 bits at a time, which numpy sorts by counting."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    if len(x) and int(x.max()) >> 16:
        order = order[np.argsort((x[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def _factors(contexts: np.ndarray, table: np.ndarray, bias) -> tuple[np.ndarray, np.ndarray, float]:
    """Each context's exponentials of its scores less its highest; its highest; how far a score lies below its highest at most."""
    out, high, apart = np.empty((len(contexts), table.shape[1]), np.float32), np.empty(len(contexts)), 0.0
    for a in range(0, len(contexts), 16 * LINES):
        z = contexts[a : a + 16 * LINES].astype(np.float64) @ table + bias
        high[a : a + 16 * LINES] = top = z.max(1)
        z -= top[:, None]
        apart = max(apart, -float(z.min()))
        out[a : a + 16 * LINES] = np.exp(z)
    return out, high, apart


def _log_sum(q: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each row's scores. Products are made in double precision and blocks have
    LINES rows always, so that a row's result doesn't hang on the rows beside it."""
    block = np.zeros((LINES, SIZE))
    block[: len(q)] = q
    z = block @ table
    z += bias
    z = z.astype(np.float32)
    top = z.max(1)
    z -= top[:, None]
    return (top + np.log(np.exp(z, out=z).sum(1, dtype=np.float64)))[: len(q)]


class Vocabulary:
    """What every task needs of the counts: FREQUENT words, or all that are symbols if they are more."""

    def __init__(self, tokens: int, distinct: int, frequent: list[tuple[int, int, int]], class_sums: np.ndarray, ends: int | None = None):
        self.id = uuid.uuid4().hex
        self.tokens, self.distinct = tokens, distinct
        words = [x for x in frequent if x[0] != _END]
        self.ends = next((n for k, _, n in frequent if k == _END), 0) if ends is None else ends
        n = np.array([x[2] for x in words], np.int64)
        m = self.words = max(WORDS, int((n >= common(tokens)).sum()))  # symbols 1 to m; where there are fewer words, some stand for none
        keys = np.array([x[0] for x in words], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.counts = n
        own = np.bincount([x[1] for x in words[:m]], n[:m] + 1, CLASSES)
        self.class_sums = class_sums - own + 1  # (c + 1) of the others, and the unseen word
        seen = np.ones(1 + m + CLASSES)
        seen[0] += self.ends
        seen[1 : 1 + len(n[:m])] += n[:m]
        seen[1 + m :] += self.class_sums
        self.unigram = seen / seen.sum()

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Places among the frequent words, by number of occurrences; -1 of others."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


class Memo(defaultdict):
    """word -> number of its entry, in the order in which words came. ``table`` has each entry's symbol, key and count (-1 of a word that
    isn't frequent), of words that came since at the next call of ``entries``. Entry 0 is the end."""

    most = 200_000

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.default_factory = count(1).__next__
        self.table = np.array([[0], [_END], [self.vocab.ends]], np.int64)

    def entries(self, at: array) -> np.ndarray:
        """Symbols, keys and counts."""
        v, words = self.vocab, list(islice(self, self.table.shape[1] - 1, None))
        if words:
            keys = keys_of(words)
            place = v.places(keys)
            symbols, counts = 1 + v.words + classes_of(words), np.full(len(words), -1)
            often = np.flatnonzero(place >= 0)
            counts[often] = v.counts[place[often]]
            own = often[place[often] < v.words]
            symbols[own] = 1 + place[own]
            self.table = np.concatenate([self.table, [symbols, keys, counts]], axis=1)
        return self.table[:, np.frombuffer(at, np.int64)]


_memos: dict[str, Memo] = {}


def _memo(vocab: Vocabulary) -> Memo:
    """The process's memo for this vocabulary."""
    if vocab.id not in _memos:
        _memos.clear()
        _memos[vocab.id] = Memo(vocab)
    return _memos[vocab.id]


def _symbols(texts, memo: Memo):
    """Symbols, keys and counts of all tokens with the ends, and each text's length in tokens."""
    blocks, sizes, at = [np.zeros((3, 0), np.int64)], [], array("q")
    for t in texts:
        words = (t or "").encode("utf-8", "replace").lower().split()
        for a in range(0, len(words), memo.most // 2):
            run = words[a : a + memo.most // 2]
            if len(memo) + len(run) > memo.most:
                blocks.append(memo.entries(at))
                memo.restart()
                at = array("q")
            at.extend(map(memo.__getitem__, run))
        at.append(0)
        sizes.append(len(words) + 1)
    blocks.append(memo.entries(at))
    sym, keys, counts = np.concatenate(blocks, axis=1)
    return sym, keys, counts, np.array(sizes, np.int64)


def _contexts(sym: np.ndarray, sizes: np.ndarray):
    """The symbol before each and the one before that; before a text stand ends."""
    first = np.cumsum(sizes) - sizes
    near = np.concatenate([[0], sym[:-1]])[: len(sym)]
    far = np.concatenate([[0, 0], sym[:-2]])[: len(sym)]
    near[first] = 0
    far[first] = 0
    far[first[sizes > 1] + 1] = 0
    return near, far


_CHUNK = "chunk long, of long, sym binary"
_PIECE = "round long, chunk long, piece int, z binary"
_CHANGES = "block long, chunk long, piece int, times binary, params binary, sums binary"


def _width(symbols: int) -> str:
    """The narrowest type that holds all symbols."""
    return "<u2" if symbols <= 1 << 16 else "<u4"


def _coded(sent, chunks: int):
    """Each training text's symbols, and the chunk that its hash deals it to."""

    def run(batches):
        for batch in batches:
            memo, texts, of = _memo(sent.value), batch.column(0), batch.column(1).to_numpy()
            for a, b in sliced(_lengths(texts), 2 << 20):
                sym, _, _, sizes = _symbols(texts.slice(a, b - a).to_pylist(), memo)
                kind = np.dtype(_width(len(memo.vocab.unigram)))
                w, raw, ends = kind.itemsize, sym.astype(kind).tobytes(), np.cumsum(sizes)
                blobs = [raw[w * (e - n) : w * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(of[a:b] % chunks), pa.array(of[a:b]), pa.array(blobs, pa.binary())], names=["chunk", "of", "sym"])

    return run


def _pieces(rounds: int, most: int):
    """Of rows sorted by chunk and hash, a chunk's texts in one row (in several, if copies of one row make it longer)."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        chunk, piece, held, size = None, 0, [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([chunk % rounds], pa.int64()), pa.array([chunk], pa.int64()), pa.array([piece], pa.int32()), pa.array([press.compress(b"".join(held))], pa.binary())], names=["round", "chunk", "piece", "z"])

        for batch in batches:
            for c, sym in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if held and (c != chunk or size > most):
                    yield row()
                    piece, held, size = piece + 1 if c == chunk else 0, [], 0
                chunk = c
                held.append(sym)
                size += len(sym)
        if held:
            yield row()

    return run


def _train(sent):
    """What each piece changes in the parameters, in blocks of rows."""

    def run(batches):
        for batch in batches:
            for chunk, piece, z in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                start = sent.value
                sym = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), _width(start.size)).astype(np.int32)
                near, far = _contexts(sym, np.diff(np.flatnonzero(sym == 0), prepend=-1))
                net = copy.copy(start)
                net.params, net.sums, net.times = start.params.copy(), start.sums.copy(), np.zeros_like(start.times)
                rng = np.random.default_rng([chunk, piece])
                for a in range(0, len(sym), RUN):
                    part = slice(a, a + RUN)
                    net.train(sym[part], near[part], far[part], rng)
                for block, a in enumerate(range(0, len(net.times), BLOCK)):
                    part = slice(a, a + BLOCK)
                    hit = net.times[part] > 0
                    if hit.any():
                        more = [net.times[part].astype("<f4"), (net.params[part] - start.params[part])[hit].astype("<f2"), (net.sums[part] - start.sums[part])[hit].astype("<f4")]
                        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([chunk], pa.int64()), pa.array([piece], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in more)], names=[f.split()[0] for f in _CHANGES.split(", ")])

    return run


def _mean(batches):
    """Of changes sorted by block, chunk and piece: each block's means over the pieces that changed a row, by how often they did."""
    block, total = None, None

    def row():
        times, params, sums = total
        hit = times > 0
        more = [times, (params[hit] / times[hit, None]), (sums[hit] / times[hit, None])]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in more)], names=["block", "times", "params", "sums"])

    for batch in batches:
        for b, t, p, s in zip(*(batch.column(n).to_pylist() for n in ("block", "times", "params", "sums")), strict=True):
            times = np.frombuffer(t, "<f4").astype(np.float64)
            if b != block:
                if block is not None:
                    yield row()
                block, total = b, [np.zeros((len(times), *k)) for k in ((), (SIZE + 1,), (2,))]
            hit = times > 0
            total[0] += times
            total[1][hit] += np.frombuffer(p, "<f2").reshape(-1, SIZE + 1) * times[hit, None]
            total[2][hit] += np.frombuffer(s, "<f4").reshape(-1, 2) * times[hit, None]
    if block is not None:
        yield row()


def fit_lm(learn: DataFrame, vocab: Vocabulary) -> LogBilinear:
    """The model of texts and hashes (__t, __of): rounds of training and averaging over all of them."""
    context = learn.sparkSession.sparkContext
    net = LogBilinear(vocab.unigram)
    size = max(CHUNK, PER_SYMBOL * net.size)
    chunks = max(1, -(-vocab.tokens // size))
    rounds = chunks.bit_length()
    coded = in_arrow(learn, _coded(context.broadcast(vocab), chunks), _CHUNK)
    pieces = materialize(in_arrow(coded.repartition("chunk").sortWithinPartitions("chunk", "of"), _pieces(rounds, 2 * size * np.dtype(_width(net.size)).itemsize), _PIECE), "lm-pieces", by="round")
    for k in range(rounds):
        sent = context.broadcast(net)
        changes = in_arrow(pieces.filter(F.col("round") == k).select("chunk", "piece", "z"), _train(sent), _CHANGES)
        means = in_arrow(changes.repartition("block").sortWithinPartitions("block", "chunk", "piece"), _mean, "block long, times binary, params binary, sums binary")
        for r in means.collect():  # no more than the parameters
            rows = r["block"] * BLOCK + np.flatnonzero(np.frombuffer(r["times"], "<f4"))
            net.params[rows] += np.frombuffer(r["params"], "<f4").reshape(-1, SIZE + 1)
            net.sums[rows] += np.frombuffer(r["sums"], "<f4").reshape(-1, 2)
        sent.unpersist()
    return net


_PARTS = "shard long, kind int, row long, doc_id long, n_tokens long, n_known long, base double, score double, rows binary, keys binary, times binary"
_SUMS = "row long, doc_id long, n_tokens long, n_known long, base double, score double"


def _score(sent, shards: int):
    """A row of sums per document (kind 1), and the words to look up, packed by shard (kind 2)."""

    def run(batches):
        vocab, net = sent.value
        row0 = TaskContext.get().partitionId() << 40
        floor = np.log10(float(vocab.tokens + vocab.distinct + 1))
        sums = np.log10(vocab.class_sums)
        for batch in batches:
            memo = _memo(vocab)
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in sliced(_lengths(texts), 2 << 20):
                sym, keys, counts, sizes = _symbols(texts.slice(a, b - a).to_pylist(), memo)
                near, far = _contexts(sym, sizes)
                score = net.log10(sym, near, far)
                known = counts > 0
                base = np.where(known, np.log10(np.maximum(counts, 0) + 1.0), 0.0) - floor
                rest = sym > vocab.words  # words that share a class
                score[rest] += np.where(known[rest], np.log10(np.maximum(counts[rest], 0) + 1.0), 0.0) - sums[sym[rest] - 1 - vocab.words]
                row = np.repeat(np.arange(b - a), sizes)
                n = b - a
                add = lambda v: np.bincount(row, v, n)
                out = [((row0 + np.arange(n)) % shards, pa.int64()), ([1] * n, pa.int32()), (row0 + np.arange(n), pa.int64()), (ids[a:b], pa.int64()), (sizes, pa.int64()), (add(known).astype(np.int64), pa.int64()), (add(base), pa.float64()), (add(score), pa.float64()), *[([None] * n, pa.binary())] * 3]
                names = [f.split()[0] for f in _PARTS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in out], names=names)
                ask = np.flatnonzero(counts == -1)
                if len(ask):
                    k, r = keys[ask], row[ask]
                    order = np.lexsort((k, r))
                    k, r = k[order], r[order]
                    starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])]))
                    times = np.diff(np.append(starts, len(k)))
                    k, r = k[starts], r[starts]
                    s = (k.view(np.uint64) % np.uint64(shards)).astype(np.int64)
                    order = np.argsort(s, kind="stable")
                    cuts = np.flatnonzero(np.diff(s[order])) + 1
                    rows = [(int(s[p[0]]), r[p].astype("<i4").tobytes(), k[p].astype("<i8").tobytes(), times[p].astype("<i4").tobytes()) for p in np.split(order, cuts)]
                    m = len(rows)
                    cols = list(zip(*rows, strict=True))
                    out = [(cols[0], pa.int64()), ([2] * m, pa.int32()), ([row0] * m, pa.int64()), *[([None] * m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], *[(c, pa.binary()) for c in cols[1:]]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in out], names=names)
                row0 += n

    return run


def _answer(batches):
    """Documents' sums as they are, and what the shard's counts add to each; the shard's counts (kind 0) come first."""
    keys = counts = None
    names = [f.split()[0] for f in _SUMS.split(", ")]
    for batch in batches:
        done = batch.filter(pa.compute.equal(batch.column("kind"), 1))
        if done.num_rows:
            yield pa.RecordBatch.from_arrays([done.column(n) for n in names], names=names)
        out = []
        for r in batch.filter(pa.compute.not_equal(batch.column("kind"), 1)).select(["shard", "kind", "row", "rows", "keys", "times"]).to_pylist():
            if r["kind"] == 0:
                if keys is None or r["shard"] != keys[0]:
                    keys, counts = (r["shard"], np.frombuffer(r["keys"], "<i8")), np.frombuffer(r["times"], "<i8")
                continue
            row, key, times = np.frombuffer(r["rows"], "<i4").astype(np.int64) + r["row"], np.frombuffer(r["keys"], "<i8"), np.frombuffer(r["times"], "<i4")
            have = keys[1] if keys is not None and keys[0] == r["shard"] else np.zeros(0, "<i8")
            at = np.minimum(np.searchsorted(have, key), max(0, len(have) - 1))
            hit = have[at] == key if len(have) else np.zeros(len(key), bool)
            if hit.any():
                row, times, c = row[hit], times[hit], counts[at[hit]]
                gain = times * np.log10(c + 1.0)
                starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                out.append((row[starts], np.add.reduceat(times.astype(np.int64), starts), np.add.reduceat(gain, starts)))
        if out:
            row, n, gain = (np.concatenate(x) for x in zip(*out, strict=True))
            none = pa.nulls(len(row), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(row), none, none, pa.array(n), pa.array(gain), pa.array(gain)], names=names)


def score_lm(docs: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Score every whole text under a model of the rows where ``train`` holds.

    Returns one row per input row: doc_id, n_tokens, n_known, train_tokens,
    base_score (unigrams with one added count), score (the model), both log10
    of the text's probability. Tokens: words between blanks, A-Z lower-cased, and one end.
    A null or empty text is its end. A null ``train`` is false; without training
    rows every count is 0 and the model is uniform over its symbols. Repeated rows each
    count and get their own row. Ids are long; other columns are passed over.
    """
    spark = docs.sparkSession
    body = F.col(text).cast("string")
    learn = docs.filter(train).select(body.alias("__t"), F.xxhash64(F.col(doc_id).cast("long"), body).alias("__of"))
    counts = in_arrow(learn.select("__t"), _count, "key long, cls int, n long").groupBy("key").agg(F.first("cls").alias("cls"), F.sum("n").alias("n"))
    counts = materialize(counts, "word-counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.filter(F.col("key") == _END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = counts.filter(F.col("key") != _END)
    sent_words = max(FREQUENT, words.filter(F.col("n") >= common(tokens)).count())
    frequent = [tuple(r) for r in words.orderBy(F.desc("n"), "key").select("key", "cls", "n").limit(sent_words).collect()]
    class_sums = np.zeros(CLASSES)
    for c, n in counts.filter("cls >= 0").groupBy("cls").agg(F.sum(F.col("n") + 1)).collect():
        class_sums[c] = n
    vocab = Vocabulary(tokens, distinct, frequent, class_sums, ends)
    net = fit_lm(learn, vocab)
    net.close()
    sent = spark.sparkContext.broadcast((vocab, net))

    # the words looked up are none of the frequent ones, so none of their shards is hot
    shards = max(16, -(-distinct // SHARD_WORDS), -(-(tokens - ends - sum(n for _, _, n in frequent)) // SHARD_TOKENS))
    two64 = (1 << 64) % shards
    of_key = F.pmod(F.pmod(F.col("key"), F.lit(shards)) + F.when(F.col("key") < 0, F.lit(two64)).otherwise(F.lit(0)), F.lit(shards)).cast("long")

    def shard(pdf):
        import pandas as pd

        pdf = pdf.sort_values("key")
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "kind": [0], "keys": [pdf["key"].to_numpy("<i8").tobytes()], "times": [pdf["n"].to_numpy("<i8").tobytes()]})

    least = frequent[-1][2] if len(frequent) == sent_words else None
    rare = words.filter("false") if least is None else words.filter(F.col("n") <= least)
    arrays = rare.withColumn("shard", of_key).groupBy("shard").applyInPandas(shard, "shard long, kind int, keys binary, times binary")
    scored = in_arrow(docs.select(F.col(doc_id).cast("long").alias("__id"), body.alias("__t")), _score(sent, shards), _PARTS)
    dealt = scored.unionByName(arrays, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "kind")
    sums = in_arrow(dealt, _answer, _SUMS)
    added = sums.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return added.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm(spark, sf_dir: str) -> DataFrame:
    """Score all documents under a model of those outside the held-out seventh."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_lm(docs, crc_class("doc_id", 7) != 2)
    return scored.select("doc_id", (crc_class("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op6_lm": op6_lm}
ORACLES: dict[str, str] = {}
