"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch go into a trie. A depth-first walk gives every
node the last token of the encoding of the prefix it stands for: of the
vocabulary's tokens that end the prefix, exactly one can follow the encoding
of what precedes it, so a node needs only its ancestors' last tokens. The
encoding of a shared prefix is thus computed once, and a word's own encoding
is read back along the chain of last tokens.

Two adjacent tokens stand if plain BPE over their joined symbols keeps the
boundary. The pieces on the right edge of the left token and on the left edge
of the right token each live from the merge that makes them to the merge that
takes them; the boundary falls if a merge across it ranks before both ends.
"""

from __future__ import annotations

import functools
import json
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, sliced, table

# Character classes of Latin-1 under Unicode: letters, numbers, white space.
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼-¾"
_S = "\t\n\x0b\x0c\r \x85\xa0"
# Letters and numbers can't start with the quote of a short form, so they may be tried before it.
_SHORT = "'(?:s|t|re|ve|m|ll|d)"
_WORDS = re.compile(f"[{_L}]+|[{_N}]|{_SHORT}|[^{_S}{_L}{_N}]+")
_SPACED = re.compile(f" ?[{_L}]+| ?[{_N}]+|{_SHORT}| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

#: Words kept encoded per process; beyond it the memo starts anew.
MEMO_WORDS = 200_000
#: Longer words are walked alone, as a trie of one path.
LONG_WORD = 2_000
#: The last symbol of a word stands for itself plus the word-end mark.
_END = 0x200
#: Marks keys from texts beyond Latin-1, whose words can't hold it.
_LETTERS = "\uffff"


def byte_letters() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Decoder:
    """The tokens of a byte-level BPE model, as stored by the tokenizers library (JSON)."""

    def __init__(self, spec: dict):
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        pairs = [*((i, t) for t, i in spec["model"]["vocab"].items()), *((i, t) for t, i in self.special.items())]
        self._strings: list = [None] * (max(i for i, _ in pairs) + 1)
        back = {c: bytes([b]) for b, c in enumerate(self.letters)}
        for i, t in pairs:
            self._strings[i] = b"".join([back.get(c) or c.encode() for c in t]) if self.byte_decoder else t

    def decode(self, packed: bytes) -> str:
        ids, names = np.frombuffer(packed, "<u4").tolist(), self._strings
        known = [names[i] for i in ids if i < len(names) and names[i] is not None]
        return b"".join(known).decode("utf-8", "replace") if self.byte_decoder else " ".join(known)


class Bpe(Decoder):
    """The model with its merges, for encoding."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        super().__init__(spec)
        model = spec["model"]
        self._blob = blob
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lower = spec.get("normalizer") is not None
        self.vocab = {self._symbols(t): i for t, i in model["vocab"].items()}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])):
            raise ValueError("only plain added tokens are supported")
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = (self._symbols(x) for x in (a, b))
            self.rank.setdefault((a, b), r)
            self.parts.setdefault(a + b, (a, b, r))
        self.table = {i: c for i, c in enumerate(self.letters)}
        self._edge: tuple[dict, dict] = ({}, {})
        self._fits: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self._library = None
        self._automaton()

    def _automaton(self) -> None:
        """The vocabulary's suffix automaton: after any text it knows the longest token that
        ends the text, and from a token the next shorter one that ends it."""
        size = max(self.vocab.values()) + 1
        self.token, self.size, self.shorter = [""] * size, [0] * size, [-1] * size
        kid, fail, out = {}, [0], [-1]
        levels: dict[int, list[tuple[int, int, int]]] = {}
        for t, i in self.vocab.items():
            self.token[i], self.size[i] = t, len(t)
            at = 0
            for depth, c in enumerate(t):
                key = at << 10 | ord(c)
                nxt = kid.get(key)
                if nxt is None:
                    nxt = kid[key] = len(fail)
                    fail.append(0)
                    out.append(-1)
                    levels.setdefault(depth, []).append((at, ord(c), nxt))
                at = nxt
            out[at] = i
        for depth in sorted(levels):
            for at, c, node in levels[depth]:
                back = fail[at] if depth else 0
                while depth and (back << 10 | c) not in kid and back:
                    back = fail[back]
                fail[node] = kid.get(back << 10 | c, 0) if depth else 0
                if out[node] >= 0:
                    self.shorter[out[node]] = out[fail[node]]
                else:
                    out[node] = out[fail[node]]
        self._kid, self._fail, self._out, self._step = kid, fail, out, {}
        self._whole = bytearray(size)  # 1: BPE of the token's symbols makes it; 2: it doesn't

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(_END + ord(token[-1]))
        return token

    def word(self, text: str, raw: bool = True) -> str:
        """A pre-token's symbols: its bytes' letters, the last marked as the end."""
        s = text.encode("utf-8", "replace").decode("latin-1").translate(self.table) if raw else text
        return s[:-1] + chr(_END + ord(s[-1])) if self.suffix and s else s

    # -- when tokens may stand beside each other

    def _chain(self, token: str, right: int) -> list[tuple[str, float]]:
        """The pieces on the token's edge, each with the rank of the merge that takes it."""
        got = self._edge[right].get(token)
        if got is None:
            got, piece, taken = [], token, float("inf")
            while True:
                got.append((piece, taken))
                made = self.parts.get(piece)
                if made is None:
                    break
                piece, taken = made[right], made[2]
            self._edge[right][token] = got
        return got

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``; also that ``right`` is a token BPE makes."""
        got, rank = self.whole(right), self.rank
        if got:
            starts = self._chain(self.token[right], 0)
            for a, a_taken in self._chain(self.token[left], 1):
                for b, b_taken in starts:
                    r = rank.get((a, b))
                    # equal ranks: the leftmost pair merges first
                    if r is not None and r < a_taken and r <= b_taken:
                        got = False
                        break
                if not got:
                    break
        if len(self._fits) > 200_000:
            self._fits.clear()
        self._fits[left << 20 | right] = got
        return got

    def whole(self, token: int) -> bool:
        """Whether BPE over the token's own symbols makes the token."""
        if not self._whole[token]:
            text = self.token[token]
            self._whole[token] = 1 if merged(self.rank, text) == [text] else 2
        return self._whole[token] == 1

    def _next(self, state: int, c: int) -> int:
        at = state
        while True:
            nxt = self._kid.get(at << 10 | c)
            if nxt is not None or not at:
                break
            at = self._fail[at]
        if len(self._step) > 200_000:
            self._step.clear()
        self._step[state << 10 | c] = nxt or 0
        return nxt or 0

    # -- words

    def encode_words(self, words) -> dict[str, bytes]:
        """Packed ids of distinct symbol strings, by one walk of their trie.

        Words go in sorted, so that the trie grows in depth-first order: what a
        word shares with the one before it is the current path, and each further
        symbol makes one node, whose last token follows from its ancestors'.
        """
        out: dict[str, bytes] = {}
        step, ends, size, shorter, pairs = self._step, self._out, self.size, self.shorter, self._fits
        last, back, before = [-1], [0], ""
        path, state = [0] * (LONG_WORD + 1), [0] * (LONG_WORD + 1)
        for w in sorted(words):
            if len(w) > LONG_WORD:
                out[w] = self._alone(w)
                continue
            depth, most = 0, min(len(before), len(w))
            while depth < most and before[depth] == w[depth]:
                depth += 1
            for depth in range(depth + 1, len(w) + 1):
                key = state[depth - 1] << 10 | ord(w[depth - 1])
                at = step.get(key)
                if at is None:
                    at = self._next(state[depth - 1], ord(w[depth - 1]))
                state[depth] = at
                t = ends[at]
                while t >= 0:
                    start = depth - size[t]
                    node = path[start]
                    if start:
                        stands = pairs.get(last[node] << 20 | t)
                        if self.fits(last[node], t) if stands is None else stands:
                            break
                    elif self.whole(t):
                        break
                    t = shorter[t]
                else:
                    raise ValueError(f"no token ends in {w[depth - 1]!r}")
                path[depth] = len(last)
                last.append(t)
                back.append(node)
            before, at, own = w, path[len(w)], []
            while at:
                own.append(last[at])
                at = back[at]
            own.reverse()
            out[w] = struct.pack(f"<{len(own)}I", *own)
        return out

    def _alone(self, w: str) -> bytes:
        """A long word, walked as a trie of one path: its nodes are its positions."""
        last, state = np.zeros(len(w) + 1, np.int32), 0
        for depth, c in enumerate(w, 1):
            at = self._step.get(state << 10 | ord(c))
            state = self._next(state, ord(c)) if at is None else at
            t = self._out[state]
            while t >= 0:
                start = depth - self.size[t]
                if self.fits_known(int(last[start]), t) if start else self.whole(t):
                    break
                t = self.shorter[t]
            else:
                raise ValueError(f"no token ends in {c!r}")
            last[depth] = t
        ids, at = [], len(w)
        while at:
            ids.append(int(last[at]))
            at -= self.size[ids[-1]]
        return np.array(ids[::-1], "<u4").tobytes()

    def fits_known(self, left: int, right: int) -> bool:
        got = self._fits.get(left << 20 | right)
        return self.fits(left, right) if got is None else got

    # -- texts

    @property
    def library(self):
        """The library's normalizer and pre-tokenizer, for texts beyond Latin-1."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._blob.decode())
        return self._library

    def words_of(self, text: str) -> list[str]:
        """Pre-tokens as memo keys; keys that start with ``_LETTERS`` hold byte letters already."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            text = text.encode("utf-8", "replace").decode()
            if self.lower:
                text = self.library.normalizer.normalize_str(text)
            return [_LETTERS + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return _WORDS.findall(text.lower()) if self.lower else _SPACED.findall(text)

    def _pieces(self, text: str):
        """Words of the text, and the special tokens in it as their ids."""
        if self.split_special is None or "<|" not in text:
            return [self.words_of(text)]
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [self.words_of(text[at : m.start()]), self.special[m.group()]]
            at = m.end()
        return [*out, self.words_of(text[at:])]

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Encodings of words that the memo lacks; the memo takes them, and starts anew when full."""
        if not new:
            return {}
        keyed = {w: self.word(w[1:], raw=False) if w[0] == _LETTERS else self.word(w) for w in new}
        got = self.encode_words(set(keyed.values()))
        fresh = {w: got[s] for w, s in keyed.items()}
        if len(self.memo) + len(fresh) > MEMO_WORDS:
            self.memo.clear()
        if len(fresh) <= MEMO_WORDS:
            self.memo.update(fresh)
        return fresh

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit) of each text."""
        out: list[bytes] = []
        for a, b in sliced(texts, 2 << 20):
            pieces = [self._pieces(t or "") for t in texts[a:b]]
            get = self.memo.get
            found = [[list(map(get, p)) if isinstance(p, list) else p for p in ps] for ps in pieces]
            fresh = self._learn({w for ps, gs in zip(pieces, found, strict=True) for p, g in zip(ps, gs, strict=True) if isinstance(g, list) and None in g for w, x in zip(p, g, strict=True) if x is None})
            for ps, gs in zip(pieces, found, strict=True):
                parts = []
                for p, g in zip(ps, gs, strict=True):
                    if not isinstance(g, list):
                        parts.append(struct.pack("<I", g))
                    elif None in g:
                        parts.append(b"".join([fresh[w] if x is None else x for w, x in zip(p, g, strict=True)]))
                    else:
                        parts.append(b"".join(g))
                out.append(parts[0] if len(parts) == 1 else b"".join(parts))
        return out


def merged(rank: dict[tuple[str, str], int], symbols: str) -> list[str]:
    """Plain BPE: merge the lowest-ranked pair, leftmost first, until none is left."""
    parts = list(symbols)
    while len(parts) > 1:
        r, i = min((rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
        if r == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@functools.lru_cache(maxsize=4)
def model(blob: bytes) -> Bpe:
    """One model per process and vocabulary file."""
    return Bpe(blob)


@functools.lru_cache(maxsize=4)
def decoder(blob: bytes) -> Decoder:
    return Decoder(json.loads(blob))


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _free(df: DataFrame, *names: str) -> None:
    if taken := {c.lower() for c in df.columns} & {n.lower() for n in names}:
        raise ValueError(f"the input has columns {sorted(taken)}; choose other names for the output")


def encode_bpe(df: DataFrame, vocabulary_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the text's token ids, packed as little-endian unsigned 32-bit (binary).

    Whole texts; a null text counts as empty and gives empty ids. Every other
    column, whatever its name or type, is kept; ``out`` must be a new name. Each
    row stands alone: ties, repeated rows and empty tables need no rule. Nothing
    is shuffled. The vocabulary file is read on the driver and sent along (a few MB).
    """
    _free(df, out)
    blob = df.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))

    def run(batches):
        bpe = model(blob.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            for a, b in sliced(texts.to_pylist() if len(texts) < 64 else _lengths(texts)):
                part = batch.slice(a, b - a)
                ids = pa.array(bpe.encode(part.column(part.schema.get_field_index("__text")).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(part.num_columns) if part.schema.field(i).name != "__text"], ids], names=[*[n for n in part.schema.names if n != "__text"], out])

    schema = ", ".join([*[f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields], f"`{out}` binary"])
    return in_arrow(df.withColumn("__text", F.col(text).cast("string")), run, schema)


def _lengths(texts) -> list:
    """Stand-ins with the texts' lengths, so that a batch is sliced before it is unpacked."""
    import pyarrow.compute as pc

    return [range(n or 0) for n in pc.binary_length(texts).to_pylist()]


def decode_bpe(df: DataFrame, vocabulary_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Replace packed ids by ``out``: the text they stand for, special tokens kept.

    Null ids give an empty text, unknown ids are passed over. Other columns stay.
    """
    _free(df, out)
    blob = df.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))

    def run(batches):
        bpe = decoder(blob.value)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            packed = batch.column(at)
            for a, b in sliced(_lengths(packed), 4 << 20):
                part = batch.slice(a, b - a)
                texts = pa.array([bpe.decode(x or b"") for x in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(part.num_columns)], texts], names=[*part.schema.names, out])

    schema = ", ".join([*[f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields], f"`{out}` string"])
    return in_arrow(df, run, schema)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode every document with the 49k word vocabulary, decode it, give digests of both."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode_bpe(docs, path).drop("text")
    return decode_bpe(ids, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op1_bpe": op1_bpe}
ORACLES: dict[str, str] = {}
