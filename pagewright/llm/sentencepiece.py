"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The distinct words of a batch become one flat numpy array of symbols. A round
finds each word's best pair (highest score, then leftmost), merges it in all words
at once, and compacts the array; words without a pair leave it. Rounds end when no
pair remains. A word's result is kept in a bounded cache.

Results equal the library's for a BPE model with identity normalisation, a dummy
prefix and byte fallback; other models are refused. Null counts as an empty text;
an empty text gives only the end id. Texts of any length are encoded whole: a word
is all that shares state, so memory follows a batch and the cache. Repeated rows get
repeated results; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import common

MARK = "▁"
#: Space runs belong to the word after them; no piece has a mark after another character.
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words that a generation of the cache holds, and their characters in all.
CACHE_WORDS, CACHE_CHARS = 200_000, 4_000_000
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if (wire := tag & 7) == 0:
            yield tag >> 3, varint()
        else:
            width = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            yield tag >> 3, data[at : at + width]
            at += width


class BPE:
    """A SentencePiece BPE model: pieces, their ranks, and a sorted table of pairs."""

    def __init__(self, model: bytes) -> None:
        pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normal: dict = {}
        for number, value in _fields(model):
            if number == 1:
                x = dict(_fields(value))
                pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        kinds = {kind for _, _, kind in pieces}
        if trainer.get(3) != 2 or normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or kinds & {USER_DEFINED, UNUSED} or BYTE not in kinds:
            raise ValueError("only BPE models with identity normalisation, a dummy prefix and byte fallback")
        vocab = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
        if any(MARK in text.lstrip(MARK) or "\n" in text for text in vocab):
            raise ValueError("a piece spans words")
        self.end = int(trainer.get(42, 2))
        self.byte_id = np.zeros(256, np.int64)
        self.raw: list[bytes] = [b""] * len(pieces)
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(text[3:5], 16)] = i
                self.raw[i] = bytes([int(text[3:5], 16)])
            elif kind == NORMAL:
                self.raw[i] = text.replace(MARK, " ").encode()
        self.raw_size = np.array([len(x) for x in self.raw], np.int64)
        self.text = [str(i) for i in range(len(pieces))]
        self.text_size = np.array([len(x) for x in self.text], np.int64)
        scores = {s: r for r, s in enumerate(sorted({s for _, s, kind in pieces if kind == NORMAL}, reverse=True))}
        # A symbol is a piece, or a character outside the vocabulary (from len(pieces) on).
        self.size = len(pieces)
        self.vocab = vocab
        table = {}
        for text, i in vocab.items():
            for cut in range(1, len(text)):
                left, right = vocab.get(text[:cut]), vocab.get(text[cut:])
                if left is not None and right is not None:
                    table[left << 32 | right] = (i, scores[pieces[i][1]])
                elif min(cut, len(text) - cut) == 1 and (left is None and cut == 1 or right is None and len(text) - cut == 1):
                    raise ValueError("a piece is made of a character outside the vocabulary")
        self.none = len(scores)
        keys = np.fromiter(table, np.int64, len(table))
        order = np.argsort(keys)
        values = np.array(list(table.values()), np.int64).reshape(-1, 2)[order]
        self.keys, self.merged, self.ranks = keys[order], values[:, 0], values[:, 1]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank ``none`` where there is no piece."""
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        found = self.keys[at] == want
        return np.where(found, self.ranks[at], self.none), np.where(found, self.merged[at], -1)

    def _chosen(self, rank: np.ndarray, word: np.ndarray, leftmost: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose pair is merged this round, and each word's best rank.

        A word merges its best pair, leftmost first, none overlapping; words in
        ``leftmost`` merge only the first of them.
        """
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        best = np.full(word[-1] + 1, self.none, np.int64)
        best[word[starts]] = np.minimum.reduceat(rank, starts)
        at = np.flatnonzero((rank == best[word]) & (rank < self.none))
        if len(at):
            new_run = np.r_[True, np.diff(at) > 1]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            if leftmost is not None:
                w = word[at]
                at = at[np.r_[True, w[1:] != w[:-1]] | ~leftmost[w]]
        return at, best

    def _round(self, state: tuple[np.ndarray, ...], leftmost: np.ndarray | None = None) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """One round: the new state and the words that merged.

        The state holds symbols, their words, and rank and merged symbol of the pair
        that each symbol forms with the next; only pairs beside a merge are looked up.
        """
        symbols, word, rank, merged = state
        at, best = self._chosen(rank, word, leftmost)
        count = np.bincount(word[at], minlength=len(best))
        if not len(at):
            return state, count > 0
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols.copy()
        symbols[at] = merged[at]
        symbols, word, rank, merged = symbols[keep], word[keep], rank[keep], merged[keep]
        fresh = (np.cumsum(keep) - 1)[at]
        side = np.r_[fresh - 1, fresh]
        side = side[side >= 0]
        last = side + 1 == len(symbols)
        after = np.where(last, side, side + 1)
        whole = ~last & (word[side] == word[after])
        opened, into = self.pairs(symbols[side], symbols[after])
        opened = np.where(whole, opened, self.none)
        rank[side], merged[side] = opened, into
        if leftmost is None:
            # Merging several at once equals one by one unless a merge opens a pair of the same or a better rank.
            w = word[side]
            wrong = np.zeros(len(best), bool)
            wrong[w[(opened <= best[w]) & (opened < self.none)]] = True
            wrong &= count > 1
            if wrong.any():
                return self._round(state, wrong)
        return (symbols, word, rank, merged), count > 0

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and where each word's ids end.

        No pair may cross from one word to the next in the texts that they come from.
        """
        text = "".join(words)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        distinct, where = np.unique(chars, return_inverse=True)
        ids = np.array([self.vocab.get(chr(c), -1) for c in distinct], np.int64)
        symbols = np.where(ids < 0, self.size + distinct, ids)[where]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        rank, merged = np.full(len(symbols), self.none, np.int64), np.full(len(symbols), -1, np.int64)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside], merged[inside] = self.pairs(symbols[inside], symbols[inside + 1])
        state, done = (symbols, word, rank, merged), []
        while len(state[0]):
            state, changed = self._round(state)
            live = changed[state[1]]
            done.append((state[0][~live], state[1][~live]))
            state = tuple(x[live] for x in state)
        symbols, word = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (symbols, word)
        order = np.argsort(word, kind="stable")
        symbols, word = symbols[order], word[order]
        if (unknown := np.flatnonzero(symbols >= self.size)).size:
            # Byte fallback: such a symbol is one character.
            as_bytes = [self.byte_id[list(chr(c - self.size).encode("utf-8", "surrogatepass"))] for c in symbols[unknown]]
            times = np.ones(len(symbols), np.int64)
            times[unknown] = [len(b) for b in as_bytes]
            at = np.cumsum(times) - times
            symbols, word = np.repeat(symbols, times), np.repeat(word, times)
            for i, b in zip(at[unknown].tolist(), as_bytes, strict=True):
                symbols[i : i + len(b)] = b
        return symbols, np.searchsorted(word, np.arange(1, len(words) + 1))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their bytes joined, without the dummy prefix."""
        raw = b"".join(self.raw[i] for i in ids)
        return raw.removeprefix(b" ").decode("utf-8", "replace")


class Words:
    """Encoded words: (number of ids, ids as text, decoded bytes, ids as int32 bytes).

    Two generations bound the cache: when the younger is full, by words or by their
    characters, it becomes the older, and words that are met again move back.
    """

    def __init__(self, bpe: BPE, limit: int = CACHE_WORDS) -> None:
        self.bpe, self.limit, self.chars = bpe, limit, 0
        self.known: dict[str, tuple[int, str, bytes, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes, bytes]] = {}

    def add(self, words: set[str]) -> None:
        if len(self.known) > self.limit or self.chars > CACHE_CHARS:
            self.known, self.older, self.chars = {}, self.known, 0
        known, older = self.known, self.older
        new = []
        for w in words.difference(known):
            if (held := older.get(w)) is None:
                new.append(w)
            else:
                known[w] = held
                self.chars += len(w)
        for lo in range(0, len(new), 50_000):
            self._encode(new[lo : lo + 50_000])

    def _encode(self, words: list[str]) -> None:
        """Each result is a slice of one text, or one run of bytes, made for all words."""
        bpe = self.bpe
        ids, ends = bpe.encode_words([w if w[0] in "\n" + MARK else MARK + w for w in words])
        starts = np.r_[0, ends[:-1]]
        before = lambda sizes: np.r_[0, np.cumsum(sizes)]
        listed, width = " ".join(map(bpe.text.__getitem__, ids.tolist())), before(bpe.text_size[ids] + 1)
        raw, length = b"".join(map(bpe.raw.__getitem__, ids.tolist())), before(bpe.raw_size[ids])
        packed = ids.astype(np.int32).tobytes()
        for w, a, b, c, d, e, f in zip(words, starts.tolist(), ends.tolist(), width[starts].tolist(), (width[ends] - 1).tolist(), length[starts].tolist(), length[ends].tolist(), strict=True):
            self.chars += len(w)
            self.known[w] = (b - a, listed[c:d], raw[e:f], packed[4 * a : 4 * b])


def _split(text: str | None) -> list[str]:
    """Words of a text: runs that no pair crosses.

    A word stands for itself with a mark before it; words that begin with a line end
    or a mark stand for themselves. No piece holds a line end.
    """
    if not text:
        return []
    if MARK not in text:
        words = text.replace("\n", " \n").split(" ")
        if "" not in words:
            return words
    return WORD.findall(MARK + text.replace(" ", MARK))


def _coder(model: bytes, result, limit: int):
    """An iterator function over Arrow arrays of texts, giving ``result(words' entries, end id)`` of each text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words(BPE(model), limit)
        for batch in batches:
            out = []
            # A chunk of texts at a time bounds what is held besides the batch.
            for lo in range(0, len(batch), 512):
                texts = [_split(t) for t in batch.slice(lo, 512).to_pylist()]
                words.add(set().union(*texts))
                entry = words.known.__getitem__
                out += [result(list(map(entry, t)), words.bpe.end) for t in texts]
            yield pa.array(out, type=result.type)

    return run


def digest(entries: list, end: int) -> dict:
    counts, ids, raw, _ = zip(*entries, strict=True) if entries else ((), (), (), ())
    text = b"".join(raw).removeprefix(b" ").decode("utf-8", "replace").encode()
    listed = " ".join((*ids, str(end))).encode()
    return {"n_tokens": sum(counts) + 1, "ids_sha256": hashlib.sha256(listed).hexdigest(), "decoded_sha256": hashlib.sha256(text).hexdigest()}


digest.type = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def token_ids(entries: list, end: int) -> np.ndarray:
    return np.frombuffer(b"".join([e[3] for e in entries]) + np.int32(end).tobytes(), np.int32)


token_ids.type = pa.list_(pa.int32())


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file's bytes; a local path of the driver or one that Spark reads."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def encode(text: Column, model: bytes, limit: int = CACHE_WORDS) -> Column:
    """Ids of each text, the end id last (array<int>)."""
    return F.arrow_udf(_typed(_coder(model, token_ids, limit)), "array<int>")(text)


def encode_digest(text: Column, model: bytes, limit: int = CACHE_WORDS) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256> of each text."""
    return F.arrow_udf(_typed(_coder(model, digest, limit)), "n_tokens long, ids_sha256 string, decoded_sha256 string")(text)


def decode(ids: Column, model: bytes) -> Column:
    """The text of each array of ids; null for null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = BPE(model)
        for batch in batches:
            yield pa.array([None if x is None else bpe.decode(x) for x in batch.to_pylist()], pa.string())

    return F.arrow_udf(_typed(run), "string")(ids)


def _typed(run):
    """arrow_udf tells its kind by the annotations themselves, not by their text."""
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def default_model(spark: SparkSession) -> bytes:
    import public_tokenizers

    return read_model(spark, public_tokenizers.path("piece_bpe_32k.model"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bound_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    coded = docs.select("doc_id", encode_digest(F.col("text"), default_model(spark)).alias("x"))
    return coded.select("doc_id", "x.n_tokens", "x.ids_sha256", "x.decoded_sha256")
