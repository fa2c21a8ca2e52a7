"""SentencePiece (merge type) encoding and decoding by a prefix table.

The encoding of every prefix of a text ends in one token. The table holds
that token: automaton matches give the tokens that end at a place, longest
first, and the one that is compatible with the last token of the prefix
before it is kept; ids are then recovered from the end backwards. Two tokens
are compatible if merging their joint text gives just these two.

Texts are cut where no vocabulary piece can lie across: before the space
mark, at line ends, and between a letter and a mark that never follows one
inside a piece. Pieces of text are encoded once and kept in a cache of fixed
size, so whole texts of any length need memory for their ids only.

Defined results: a null or empty text has no ids and decodes to the empty
text; characters outside the vocabulary become their UTF-8 bytes; repeated
rows are encoded alike; an empty table gives an empty result; other columns
are passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphlore.plans.shared import bound_batches

MARK = "▁"
#: Entries of each generation of the cache of encoded pieces of text, and of the cache of tested pairs.
CACHE, PAIRS = 150_000, 400_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


class _Known(dict):
    """Ids of pieces of text; what is not there is encoded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> tuple[int, ...]:
        return self.make(text)


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        text = [i for i in range(size) if i not in special and i not in self.byte_of]
        self.score = {self.pieces[i]: model.get_score(i) for i in text}
        self.known = {p for p in self.score if len(p) == 1}
        self.id_of = {self.pieces[i]: i for i in text}
        self.length = [len(p) for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for i in text:
            if self.merged(self.pieces[i]) == [self.pieces[i]]:
                self.automaton.add_word(self.pieces[i], (self.length[i], i))
        self.automaton.make_automaton()
        self.cutter = self._cutter()
        self.shown = [self.pieces[i].replace(MARK, " ") if i not in special else "" for i in range(size)]
        self.pairs: dict[int, bool] = {}
        self.new, self.old = _Known(self._piece), _Known(self._piece)

    def _cutter(self) -> re.Pattern:
        """Cuts a text where no piece lies across."""
        if any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in self.score):
            return re.compile(r"(?s).+")
        letter = re.compile(f"[{_LETTERS}]")
        after = {b for p in self.score for a, b in zip(p, p[1:], strict=False) if letter.match(a) and not letter.match(b)}
        ends = "".join(re.escape(chr(c)) for c in range(33, 127) if chr(c) not in after and not chr(c).isalpha())
        return re.compile(f"{MARK}*[{_LETTERS}]++(?=[{ends}{MARK}\\n]|$)|\\n|{MARK}*[^{MARK}\\n]+|{MARK}+")

    def merged(self, text: str) -> list[str]:
        """A short text merged step by step: the pair of the highest score, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            known = self.merged(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _table(self, text: str) -> list[int]:
        """Ids of a piece of text whose characters are all in the vocabulary."""
        last: list[int] = [-1] * len(text)
        pairs = self.pairs
        for end, (size, i) in self.automaton.iter(text):
            if last[end] < 0:
                start = end - size
                if start < 0:
                    last[end] = i
                elif (p := last[start]) >= 0:
                    ok = pairs.get(p << 20 | i)
                    if ok or ok is None and self.compatible(p, i):
                        last[end] = i
        ids, end, length = [], len(text) - 1, self.length
        while end >= 0:
            i = last[end]
            if i < 0:
                raise ValueError(f"no token ends the prefix {text[: end + 1]!r}")
            ids.append(i)
            end -= length[i]
        return ids[::-1]

    def _piece(self, text: str) -> tuple[int, ...]:
        ids = self.old.get(text)  # not [text], which would encode it there
        if ids is None:
            if self.known.issuperset(text):
                ids = tuple(self._table(text))
            else:
                out: list[int] = []
                for part in re.split("([^" + re.escape("".join(set(text) & self.known)) + "])" if set(text) & self.known else "(.)", text, flags=re.DOTALL):
                    if part and self.known.issuperset(part):
                        out += self._table(part)
                    else:
                        out += [self.bytes[b] for b in part.encode()]
                ids = tuple(out)
        if len(self.new) >= CACHE:
            self.old, self.new = self.new, _Known(self._piece)
        self.new[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        parts = self.cutter.findall(MARK + text.replace(" ", MARK))
        return list(chain.from_iterable(map(self.new.__getitem__, parts)))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, bytes read as UTF-8, the mark before the first piece dropped."""
        if not ids:
            return ""
        shown = self.shown
        if self.byte_of.keys().isdisjoint(ids):
            out = "".join([shown[i] for i in ids])
        else:
            parts, run = [], bytearray()
            for i in ids:
                b = self.byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                parts.append(shown[i])
            parts.append(run.decode("utf-8", "replace"))
            out = "".join(parts)
        return out[1:] if out.startswith(" ") and shown[ids[0]].startswith(" ") else out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(made: list[list[int]]) -> pa.Array:
    ends = np.zeros(len(made) + 1, dtype=np.int32)
    np.cumsum([*map(len, made)], out=ends[1:])
    flat = np.fromiter(chain.from_iterable(made), dtype=np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _id_lists(lists: pa.Array) -> list[list[int]]:
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *[n or 0 for n in lists.value_lengths().to_pylist()]])
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def _texts(c: Codec, lists: list[list[int]]) -> pa.Array:
    return pa.array([c.decode(x) for x in lists], pa.string())


def _added(docs: DataFrame, fields: dict[str, str], make) -> DataFrame:
    """``docs`` with columns made batch by batch; a column of the same name is replaced."""
    bound_batches(docs.sparkSession, rows=400, mb=8)
    kept = docs.drop(*fields)
    schema = T.StructType(kept.schema.fields + [T.StructField(f, T._parse_datatype_string(kind)) for f, kind in fields.items()])
    inputs = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(k) for k, c in enumerate(inputs) if c not in fields]
            yield pa.RecordBatch.from_arrays([*own, *make(batch)], names=schema.names)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, model: str | None = None, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text``. ``model``: file path; None: the public 32k merge model."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        c = codec(model or _public())
        return [_lists([c.encode(t or "") for t in batch.column(text).to_pylist()])]

    return _added(docs, {to: "array<int>"}, make)


def decode(docs: DataFrame, model: str | None = None, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the text that ``ids`` decode to; null ids decode to the empty text."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        return [_texts(codec(model or _public()), _id_lists(batch.column(ids)))]

    return _added(docs, {to: "string"}, make)


def round_trip(docs: DataFrame, model: str | None = None, text: str = "text", ids: str = "ids", to: str = "decoded") -> DataFrame:
    """:func:`encode`, then :func:`decode` of what it gave, in one pass over the rows."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        c = codec(model or _public())
        made = [c.encode(t or "") for t in batch.column(text).to_pylist()]
        return [_lists(made), _texts(c, made)]

    return _added(docs, {ids: "array<int>", to: "string"}, make)


def _public() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
