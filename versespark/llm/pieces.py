"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

A text becomes its normal form (a mark before it and for every blank). Merging puts together, again and again, the leftmost pair of
the best score. Its result is the only cut into pieces whose neighbours are compatible: merging the two alone gives these
two. So no merge is made over the text: an Aho-Corasick automaton of the reversed pieces lists the pieces that start at each place,
longest first; the longest that is compatible with the piece before is taken; where none is, the place is marked as failed in a
bit field and the piece before is given up for its next shorter one. Pieces that merging never makes of their own characters are left
out. Compatibility is found by merging the two pieces again, once per pair.

Texts are cut first where no piece of the vocabulary crosses: before a mark, if no piece holds a mark after another character,
around characters that no longer piece holds, and between Latin letters and others, if no piece holds both side by side. Each different part is encoded once
and kept in a bounded table of the Python process.

Defined cases: null texts count as empty (begin and end ids only, empty text); texts and words of any length are encoded whole;
characters without a piece become their bytes; strings that look like control pieces are plain text; repeated rows agree; the
input's columns stay, those named like a result column are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

#: The character that stands for a blank. A fixed value of the format.
MARK = "▁"
#: Parts, and pairs of pieces, kept by a task; a table is emptied beyond this.
MOST_PARTS, MOST_PAIRS = 500_000, 500_000
#: Letters between which and other characters a text is cut, if no piece holds both side by side.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"


class PieceCoder:
    """Encoder and decoder for a merge-type model file with byte fallback; its size is that of the vocabulary."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            data = f.read()
        model.ParseFromString(data)
        self.name = hashlib.sha256(data).hexdigest()
        kinds, norm = model.SentencePiece.Type, model.normalizer_spec
        plain = norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not norm.precompiled_charsmap
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback or not plain or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models with byte fallback and plain normalisation are supported")
        if any(p.type in (kinds.UNUSED, kinds.USER_DEFINED) for p in model.pieces):
            raise ValueError("unused and user-defined pieces are not supported")
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        long = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(map(re.escape, sorted(c for c in map(chr, range(128)) if c not in long)))
        inside = any(p[i] == MARK and p[i - 1] != MARK for p in self.ids for i in range(1, len(p)))
        latin = re.compile(f"[{LATIN}]").match
        mixed = any(MARK not in p[i - 1:i + 1] and bool(latin(p[i])) != bool(latin(p[i - 1])) for p in self.ids for i in range(1, len(p)))
        words = [f"[^{MARK}{alone}]"] if mixed else [f"[{LATIN}]", f"[^{MARK}{alone}{LATIN}]"]
        self.parts = rf"[^{alone}]+|[{alone}]" if inside else "|".join([f"{MARK}*{w}+" for w in words] + [f"[{alone}]", f"{MARK}+"])
        # What a piece's own characters merge to is its last merge at the latest; others never come out.
        self.made = [p for p in self.ids if self.merged(p) == [p]]
        self._ready()

    def _ready(self) -> None:
        self.fits: dict[tuple[str, str], bool] = {}
        self.coded: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}
        self.text_of = {i: p.replace(MARK, " ") for p, i in self.ids.items()}
        self.automaton, made = ahocorasick.Automaton(), set(self.made)
        for p in self.made:
            # A piece and the shorter ones that it begins with, longest first: all that start where it is the longest.
            self.automaton.add_word(p[::-1], tuple(p[:n] for n in range(len(p), 0, -1) if p[:n] in made or n == 1))
        self.automaton.make_automaton()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "fits", "text_of", "coded", "shown")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: the best score first, of equal ones the leftmost."""
        symbols, score, none = list(text), self.scores.get, float("-inf")
        pairs = [score(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while pairs and (best := max(pairs)) > none:
            at = pairs.index(best)
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = score(symbols[at] + symbols[at + 1], none)
            if at:
                pairs[at - 1] = score(symbols[at - 1] + symbols[at], none)
        return symbols

    def compatible(self, left: str, right: str) -> bool:
        if len(self.fits) > MOST_PAIRS:
            self.fits.clear()
        known = self.fits[left, right] = self.merged(left + right) == [left, right]
        return known

    def cut(self, text: str) -> list[str]:
        """The pieces of a text in normal form."""
        n, fits = len(text), self.fits
        last = n - 1
        starts: list[tuple[str, ...] | None] = [None] * n
        for end, found in self.automaton.iter(text[::-1]):
            if starts[last - end] is None:  # the longest of a place comes first
                starts[last - end] = found
        open_ = bytearray(b"\xff") * (n // 8 + 1)  # one bit a place: not yet failed
        out: list[str] = []
        tried: list[int] = []  # for each piece taken, the number of the next shorter one
        at, number, before, failed = 0, 0, "", False
        while at < n:
            found = starts[at]
            if found is None:
                found = starts[at] = (text[at],)
            while number < len(found):
                piece = found[number]
                number += 1
                end = at + len(piece)
                if not failed or open_[end >> 3] >> (end & 7) & 1:
                    fit = fits.get((before, piece)) if before else True
                    if fit or (fit is None and self.compatible(before, piece)):
                        out.append(piece)
                        tried.append(number)
                        at, number, before = end, 0, piece
                        break
            else:
                failed = True
                open_[at >> 3] &= ~(1 << (at & 7))
                at -= len(out.pop())
                number = tried.pop()
                before = out[-1] if out else ""
        return out

    def encode_part(self, part: str) -> list[int]:
        ids: list[int] = []
        for piece in self.cut(part):
            known = self.ids.get(piece)
            if known is None:
                ids += [self.bytes[b] for b in piece.encode()]
            else:
                ids.append(known)
        return ids

    def decode_part(self, ids: list[int]) -> str:
        """The text of ids, marks as blanks. Bytes in a row are UTF-8, each that is none becomes a replacement character."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.text_of.get(i, "") for i in ids])
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            out += [held.decode(errors="replace"), self.text_of.get(i, "")]
            held.clear()
        return "".join(out) + held.decode(errors="replace")

    def learn(self, parts: set[str]) -> None:
        """Encode the parts that are not in the tables yet."""
        if len(self.coded) > MOST_PARTS:
            self.coded.clear()
            self.shown.clear()
        for part in parts - self.coded.keys():
            ids = self.encode_part(part)
            self.coded[part] = struct.pack(f"<{len(ids)}I", *ids)
            self.shown[part] = self.decode_part(ids)


#: The coder of a Python process, which serves all tasks that run in it one after the other; one model at a time.
_held: dict[str, PieceCoder] = {}


def _coder(name: str, shared: Broadcast[PieceCoder]) -> PieceCoder:
    if name not in _held:
        _held.clear()
        _held[name] = shared.value
    return _held[name]


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
          T.StructField("packed", T.BinaryType()), T.StructField("decoded", T.StringType())]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` (begin and end included), ``packed`` (the ids as little-endian unsigned 32-bit
    integers) and ``decoded`` (the text that the ids give back).

    The tokenizer's tables, whose size the file fixes, are broadcast.
    """
    docs = docs.drop(*[f.name for f in FIELDS])
    columns, schema = docs.columns, T.StructType([*docs.schema, *FIELDS])
    coder = PieceCoder(path)
    name, shared = coder.name, docs.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, shared)
        parts_in, coded, shown = re.compile(coder.parts).findall, coder.coded, coder.shown
        first, last = (struct.pack("<I", i) for i in (coder.begin, coder.end))
        for batch in batches:
            for rows in slices(batch, "text"):
                texts = [parts_in(MARK + t.replace(" ", MARK)) if t else [] for t in rows.column("text").to_pylist()]
                coder.learn(set().union(*texts))
                packed = [b"".join([first, *map(coded.__getitem__, parts), last]) for parts in texts]
                # The mark before a text is not part of it.
                decoded = ["".join(map(shown.__getitem__, parts))[1:] for parts in texts]
                ends = np.cumsum([0, *[len(p) // 4 for p in packed]], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in columns], pa.array(np.diff(ends).astype(np.int64)), ids.cast(pa.list_(pa.field("element", pa.int32(), False))),
                     pa.array(packed, pa.binary()), pa.array(decoded, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)
