"""BPE encoding and decoding by a segment tree over the ranks of adjacent pairs.

A text is normalised and cut into words as the tokenizer file says. Each word's symbols lie under a
segment tree whose leaves are (rank, place) of adjacent pairs, so the root is the leftmost
lowest-rank merge; a merge changes three leaves and their ancestors, until the root is infinite.
Words of one length go through their trees together, one numpy row each, the last few one by one. Words are
encoded once per slice of a partition and kept in a bounded table.

Defined cases: null texts count as empty (no tokens, empty strings); texts of any length, and single words
of any length, are encoded whole; special tokens' strings in a text are special tokens, as the library has it;
repeated rows agree; the input's columns stay, those named like a result column are replaced.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

#: Words kept between slices; the table is emptied beyond this.
MOST_WORDS = 200_000
#: Rows that are still merging, down to which a numpy step serves them together; the last go one by one.
FEW_ROWS = 3
INFINITE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if it prints, else the next code point from 256."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in prints)}
    return [chr(rest.get(b, b)) for b in range(256)]


class WordBpe:
    """Encoder of words for a tokenizer file with end-of-word symbols; picklable, of fixed size."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pre = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word_pattern = pre
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        signs = byte_symbols()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.final = np.array([vocab[s + suffix] for s in signs], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.base = len(vocab) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.pairs = dict(zip(keys.tolist(), range(len(merges)), strict=True))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge (or a side is missing, -1)."""
        key = np.where((left < 0) | (right < 0), -1, left * self.base + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_rows(self, data: np.ndarray) -> np.ndarray:
        """Token ids of words of one length, a row of bytes each; -1 where a symbol was merged away."""
        rows, n = data.shape
        symbols = self.inner[data]
        symbols[:, -1] = self.final[data[:, -1]]
        if n == 1:
            return symbols
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        bits = width.bit_length()

        def leaf(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
            return np.where(rank < 0, INFINITE, (rank << bits) | place)

        tree = np.full((rows, 2 * width), INFINITE)
        tree[:, width:width + n - 1] = leaf(self.rank(symbols[:, :-1], symbols[:, 1:]), np.arange(n - 1))
        level = width
        while level > 1:
            half = level >> 1
            tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level = half
        # One column beyond the end: place n is "none", before the first is -1, which is that column too.
        after = np.tile(np.arange(1, n + 2), (rows, 1))
        before = np.tile(np.arange(-1, n), (rows, 1))
        symbols = np.concatenate([symbols, np.full((rows, 1), -1)], axis=1)
        active = np.flatnonzero(tree[:, 1] < INFINITE)
        while active.size > FEW_ROWS:
            root = tree[active, 1]
            at, rank = root & ((1 << bits) - 1), root >> bits
            gone = after[active, at]
            follow, prior = after[active, gone], before[active, at]
            new = self.made[rank]
            symbols[active, at] = new
            symbols[active, gone] = -1
            after[active, at] = follow
            before[active, follow] = at
            self._set(tree, active, width, gone, np.full(active.size, INFINITE))
            self._set(tree, active, width, at, leaf(self.rank(new, symbols[active, follow]), at))
            left = np.where(prior < 0, -1, symbols[active, prior])
            some = prior >= 0
            self._set(tree, active[some], width, prior[some], leaf(self.rank(left, new), prior)[some])
            active = active[tree[active, 1] < INFINITE]
        for row in active.tolist():
            symbols[row] = self._merge_one(tree[row].tolist(), symbols[row].tolist(), before[row].tolist(), after[row].tolist(), width, bits)
        return symbols[:, :n]

    def _merge_one(self, tree: list, symbols: list, before: list, after: list, width: int, bits: int) -> list:
        """The rest of one row's merges: the same tree in plain lists, which numpy steps on one row would only slow down."""
        def put(place: int, left: int, right: int) -> None:
            if place >= width:
                return
            found = self.pairs.get(left * self.base + right) if left >= 0 and right >= 0 else None
            node = place + width
            tree[node] = INFINITE if found is None else (found << bits) | place
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b

        while tree[1] < INFINITE:
            at, new = tree[1] & ((1 << bits) - 1), int(self.made[tree[1] >> bits])
            gone = after[at]
            follow, prior = after[gone], before[at]
            symbols[at], symbols[gone] = new, -1
            after[at], before[follow] = follow, at
            put(gone, -1, -1)
            put(at, new, symbols[follow])
            if prior >= 0:
                put(prior, symbols[prior], new)
        return symbols

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, width: int, place: np.ndarray, value: np.ndarray) -> None:
        """Point update: a leaf and its ancestors. A place beyond the last pair has no leaf."""
        there = place < width
        rows, node = rows[there], place[there] + width
        tree[rows, node] = value[there]
        while node.size and node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of each word, in no given order."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode()
            by_length.setdefault(len(data), []).append((word, data))
        for n, group in by_length.items():
            step = max(1, (1 << 18) // n)
            for i in range(0, len(group), step):
                part = group[i:i + step]
                data = np.frombuffer(b"".join(d for _, d in part), np.uint8).reshape(len(part), n)
                ids = self.encode_rows(data)
                there = ids >= 0
                ends = np.cumsum(there.sum(axis=1))
                flat = ids[there].tolist()
                start = 0
                for (word, _), end in zip(part, ends.tolist(), strict=True):
                    yield word, flat[start:end]
                    start = end


def normalised(text: str) -> str:
    """NFC, then lower case letter by letter (no final-sigma rule). White space only parts words."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` (decimal ids joined by a space) and ``decoded``.

    The tokenizer's tables, whose size the file fixes, are broadcast.
    """
    names = ("n_tokens", "ids", "decoded")
    docs = docs.drop(*names)
    columns = docs.columns
    schema = T.StructType([*docs.schema, T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(WordBpe(path))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        words_in = regex.compile(bpe.word_pattern).findall
        special = regex.compile("(" + "|".join(map(regex.escape, sorted(bpe.special, key=len, reverse=True))) + ")")
        known: dict[str, tuple[int, str, str]] = {}

        def keep(word: str, ids: list[int]) -> None:
            known[word] = len(ids), " ".join(map(str, ids)), " ".join([bpe.tokens[i] for i in ids])

        def cut(text: str | None) -> list[str]:
            if not text:
                return []
            if "<|" not in text:
                return words_in(normalised(text))
            out = []
            for piece in special.split(text):
                out += [piece] if piece in bpe.special else words_in(normalised(piece))
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                if len(known) > MOST_WORDS or not known:
                    known.clear()
                    for token, number in bpe.special.items():
                        keep(token, [number])
                texts = [cut(t) for t in part.column("text").to_pylist()]
                new = set().union(*texts) - known.keys()
                for word, ids in bpe.encode_words(list(new)):
                    keep(word, ids)
                found = [[known[w] for w in words] for words in texts]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in columns],
                     pa.array([sum([x[0] for x in row]) for row in found], pa.int64()),
                     pa.array([" ".join([x[1] for x in row]) for row in found], pa.string()),
                     pa.array([" ".join([x[2] for x in row]) for row in found], pa.string())],
                    names=[f.name for f in schema])

    return docs.mapInArrow(encoded, schema)
