"""SentencePiece encoding by a table of last tokens, and decoding.

In a merge vocabulary (highest score first, leftmost on ties) a token sequence is
the encoding of its text exactly if each neighbouring pair is the encoding of
its own text.  So every prefix of a text has one last token: among the pieces
that end there (one pass of an automaton over the text lists them) it is the one
that is compatible with the last token of the prefix before it.  The table is
filled from left to right and the ids are read off backwards.

No piece may join a symbol before a space mark with the mark, nor contain a
symbol that no piece has: there the text is cut first, and the ids of a segment
are remembered for its next occurrence.  A vocabulary whose pieces do join them
is not cut.
"""
from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from satledger.llm.common import arrow_bytes, arrow_text, numbered, place, small_batches

#: Model file (a parameter; never copied).
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the format: space mark, and the surface of an unknown id.
MARK, UNKNOWN = "▁", " ⁇ "
#: Segments and token pairs that a task remembers; longer segments are not kept.
REMEMBERED, SEGMENT = 1 << 19, 64
#: Cuts worth making: symbols that often stand between words.
BREAKS = "\n\t\r"


def _one_by_one(error):
    """Each byte that starts no character becomes one replacement character."""
    return "�", error.start + 1


codecs.register_error("one_by_one", _one_by_one)


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number, and integer or bytes."""
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (message[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if message[at - 1] < 128:
                return value, at

    at = 0
    while at < len(message):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = message[at:at + size], at + size
        yield tag >> 3, value


class Pieces:
    """Vocabulary of a model: its pieces, their scores, and the texts of its ids."""

    def __init__(self, model: bytes):
        vocabulary = sentencepiece.SentencePieceProcessor(model_proto=model)
        message = dict(_fields(model))
        trainer, normalizer = dict(_fields(message[2])), dict(_fields(message[3]))
        # field numbers of the model format: model type, byte fallback; normaliser name, dummy prefix, extra spaces
        if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(1) != b"identity" or normalizer.get(4, 1):
            raise ValueError("a merge vocabulary with byte fallback and the identity normaliser is needed")
        self.prefix = bool(normalizer.get(3, 1))
        self.size, self.bos, self.eos = vocabulary.vocab_size(), vocabulary.bos_id(), vocabulary.eos_id()
        self.text = [vocabulary.id_to_piece(i) for i in range(self.size)]
        self.score = vocabulary.get_score(list(range(self.size)))
        special = {i for i in range(self.size) if vocabulary.is_control(i) or vocabulary.is_unknown(i)}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(self.size) if vocabulary.is_byte(i)}
        usual = [i for i in range(self.size) if i not in special and not vocabulary.is_byte(i)]
        self.id = {self.text[i]: i for i in usual}
        symbols = set("".join(self.id))
        joined = any(a != MARK == b for p in self.id for a, b in zip(p, p[1:]))
        breaks = "".join(c for c in BREAKS if c not in symbols)
        cut = f"[{breaks}]|{MARK}*[^{MARK}{breaks}]+|{MARK}+" if breaks else f"{MARK}*[^{MARK}]+|{MARK}+"
        self.segments = (lambda t: [t]) if joined else re.compile(cut, re.DOTALL).findall
        self.surface = [b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(self.text)]
        for b, i in self.byte.items():
            self.surface[i] = bytes([b])
        if vocabulary.unk_id() >= 0:
            self.surface[vocabulary.unk_id()] = UNKNOWN.encode()
        self.control = np.array([vocabulary.is_control(i) for i in range(self.size)])
        self.marked = np.array([p.startswith(MARK) and p in self.id for p in self.text])


class Encoder:
    """Ids of texts; the table of last tokens of each segment's prefixes."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._automaton = ahocorasick.Automaton()
        for text, i in pieces.id.items():
            self._automaton.add_word(text, (i, len(text)))
        self._automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._known = _Known(self)

    def _merged(self, text: str) -> list[str]:
        """Merge the symbols of a short text pair by pair."""
        id_of, score = self.pieces.id, self.pieces.score
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens (``left`` -1: none) are the encoding of their joined text."""
        if len(self._fits) >= REMEMBERED:
            self._fits.clear()
        text = self.pieces.text
        want = [text[right]] if left < 0 else [text[left], text[right]]
        fits = self._fits[left * self.pieces.size + right] = self._merged("".join(want)) == want
        return fits

    def segment(self, text: str) -> list[int]:
        """Ids of one segment."""
        # last token and its length by the end of the prefix; -1: none, or a symbol without a piece
        last, width = [-1] * (len(text) + 1), [1] * (len(text) + 1)
        known, size = self._fits, self.pieces.size
        for end, (i, n) in self._automaton.iter(text):
            end += 1
            if last[end] < 0:
                left = last[end - n]
                fits = known.get(left * size + i)
                if fits or fits is None and self.compatible(left, i):
                    last[end], width[end] = i, n
        ids, end = [], len(text)
        while end > 0:
            if last[end] >= 0:
                ids.append(last[end])
            else:
                ids.extend(self.pieces.byte[b] for b in reversed(text[end - 1].encode()))
            end -= width[end]
        ids.reverse()
        return ids

    def ids(self, text: str, bos: bool = True, eos: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        p = self.pieces
        if text:
            text = (MARK if p.prefix else "") + text.replace(" ", MARK)
        body = b"".join(map(self._known.__getitem__, p.segments(text) if text else ()))
        return (p.bos.to_bytes(4, "little") if bos else b"") + body + (p.eos.to_bytes(4, "little") if eos else b"")


class _Known(dict):
    """Ids by segment; a new segment is encoded."""

    def __init__(self, encoder: Encoder):
        self._encoder = encoder

    def __missing__(self, segment: str) -> bytes:
        ids = self._encoder.segment(segment)
        ids = pack(f"<{len(ids)}I", *ids)
        if len(segment) <= SEGMENT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[segment] = ids
        return ids


class Decoder:
    """Texts of rows of ids, as bytes of all rows at once."""

    def __init__(self, pieces: Pieces):
        self._pieces = pieces
        self._length = np.array([len(s) for s in pieces.surface], np.int64)
        self._start = np.cumsum(self._length) - self._length
        self._data = np.frombuffer(b"".join(pieces.surface), np.uint8)

    def texts(self, ids: np.ndarray, rows: np.ndarray) -> list[str]:
        """``rows``: the ``n + 1`` offsets of the rows in ``ids``; ids beyond the
        vocabulary raise ``IndexError``."""
        start, length = self._start[ids], self._length[ids]
        if self._pieces.prefix and len(ids):
            # the mark that encoding put before a text goes: that of its first piece with a text
            seen = np.flatnonzero(~self._pieces.control[ids])
            first = np.searchsorted(seen, rows[:-1])
            found = first < len(seen)
            first = seen[np.minimum(first, max(len(seen) - 1, 0))] if len(seen) else first
            first = first[found & (first < rows[1:])]
            first = first[self._pieces.marked[ids[first]]]
            start[first] += 1
            length[first] -= 1
        ends = np.concatenate(([0], np.cumsum(length)))
        at = np.repeat(start - ends[:-1], length) + np.arange(ends[-1])
        data = self._data[at].tobytes()
        # a control id ends a run of bytes: the bytes on its two sides make no character together
        places = np.flatnonzero(self._pieces.control[ids])
        parts = [[] for _ in rows[1:]]
        cuts = np.union1d(rows, places)
        owners = np.searchsorted(rows, cuts[:-1], "right") - 1
        for row, a, b in zip(owners.tolist(), ends[cuts[:-1]].tolist(), ends[cuts[1:]].tolist()):
            parts[row].append(data[a:b].decode("utf-8", "one_by_one"))
        return ["".join(p) for p in parts]


@lru_cache(maxsize=1)
def _tools(model: bytes) -> tuple[Encoder, Decoder]:
    """Once per worker process: its later tasks find the segments known."""
    pieces = Pieces(model)
    return Encoder(pieces), Decoder(pieces)


def _encode(model, bos: bool, eos: bool, out: pa.Schema):
    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder, _ = _tools(model.value)
        for batch in batches:
            ids = [encoder.ids(t.decode("utf-8", "replace"), bos, eos) for t in arrow_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, out[0].type), *batch.columns[1:]], schema=out)

    return run


def _decode(model, out: pa.Schema):
    def run(batches) -> Iterator[pa.RecordBatch]:
        _, decoder = _tools(model.value)
        for batch in batches:
            raw, at = arrow_text(batch.column(0))
            ids = np.frombuffer(raw[at[0]:at[-1]].tobytes(), "<u4")
            texts = decoder.texts(ids, (at - at[0]) // 4)
            yield pa.RecordBatch.from_arrays([pa.array(texts, out[0].type), *batch.columns[1:]], schema=out)

    return run


def _list(out: pa.Schema):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = arrow_text(batch.column(0))
            ids = np.frombuffer(raw[at[0]:at[-1]].tobytes(), "<u4").astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array((at - at[0]) // 4, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([lists.cast(out[0].type), *batch.columns[1:]], schema=out)

    return run


def _mapped(rows: DataFrame, first: Column, name: str, kind: str, function) -> DataFrame:
    """``rows`` with a further column, last, computed from ``first``: the other columns travel under
    numbers and get their names back by position, so any names may clash."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(rows.sparkSession)
    names, plain = rows.columns, numbered(rows)
    sent = plain.select(first.alias("x"), "*")
    out = StructType.fromDDL(f"x {kind}")
    for field in plain.schema.fields:
        out.add(field)
    made = sent.mapInArrow(function(to_arrow_schema(out)), out)
    return made.select(*(f"c{i}" for i in range(len(names))), "x").toDF(*names, name)


def _held(rows: DataFrame, model: str):
    """The model file (its size is that of the vocabulary) for the tasks."""
    with open(model, "rb") as f:
        return rows.sparkSession.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, text_col: str = "text", model: str = MODEL, bos: bool = True, eos: bool = True) -> DataFrame:
    """``docs`` with a last column ``ids``: the ids of the text as binary, four bytes
    each, little-endian (:func:`n_ids`, :func:`listed`).

    Null and empty texts have the begin and end ids only.  Texts of any length are
    encoded whole; bytes that are no UTF-8 count as U+FFFD.  Repeated rows, ties and
    hot texts: each row by itself, no shuffle.  Empty tables give no rows.  All
    columns of ``docs`` stay as they are, whatever their names: a column named
    ``ids`` stays too, before the new one."""
    held = _held(docs, model)
    return _mapped(docs, place(docs, text_col), "ids", "binary", lambda s: _encode(held, bos, eos, s))


def decoded(rows: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``rows`` with a last column ``decoded``: the text of the ids in ``ids_col`` (binary
    as :func:`encoded` gives them).

    Control ids have no text, byte ids that make no character become U+FFFD one by
    one, and the space that encoding puts before a text is taken off.  Null or empty
    ids give an empty text; ids beyond the vocabulary fail.  Repeated rows, empty
    tables and clashing names as in :func:`encoded`."""
    held = _held(rows, model)
    return _mapped(rows, place(rows, ids_col), "decoded", "string", lambda s: _decode(held, s))


def listed(rows: DataFrame, ids_col: str = "ids") -> DataFrame:
    """``rows`` with a last column ``id_list``: the binary ids as ``array<bigint>``; null ids give an empty one."""
    return _mapped(rows, place(rows, ids_col), "id_list", "array<bigint>", _list)


def n_ids(ids: str | Column = "ids") -> Column:
    return F.floor(F.octet_length(ids) / 4)
