"""SentencePiece encoding that keeps where in the text every piece came from."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from culprit.llm.shared import slices, tidied

# What a space becomes inside the model.
SPACE = "▁".encode()

# Texts given to the library at once.
BATCH = 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class CharMap:
    """A compiled character map: a double-array trie of prefixes and their new texts.

    `longest(text, at)` gives the new bytes for the longest prefix of text[at:] that the
    map knows and how many bytes it covers.  What no prefix covers is one character of
    itself; a byte that begins no valid character becomes the replacement character.
    """

    def __init__(self, compiled: bytes):
        self.units, self.texts = np.zeros(0, np.uint32), b""
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = np.frombuffer(compiled, "<u4", size // 4, 4)
            self.texts = compiled[4 + size :]
        self.heads = self._known_heads()

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _known_heads(self) -> np.ndarray:
        """Which first bytes lead into the trie."""
        known = np.zeros(256, bool)
        if len(self.units):
            root = self._step(int(self.units[0]))
            for byte in range(256):
                known[byte] = int(self.units[root ^ byte]) & 0x800000FF == byte
        return known

    def longest(self, text: bytes, at: int) -> tuple[bytes, int]:
        units = self.units
        covered = new = 0
        if len(units):
            node = self._step(int(units[0]))
            for end in range(at, len(text)):
                byte = text[end]
                node ^= byte
                unit = int(units[node])
                if unit & 0x800000FF != byte:
                    break
                node ^= self._step(unit)
                if unit >> 8 & 1:
                    new, covered = int(units[node]) & 0x7FFFFFFF, end + 1 - at
        if covered:
            return self.texts[new : self.texts.index(b"\0", new)], covered
        head = text[at]
        size = 1 if head < 0x80 else 2 if head < 0xE0 else 3 if head < 0xF0 else 4
        char = text[at : at + size]
        try:
            char.decode()
        except UnicodeDecodeError:
            return "�".encode(), 1
        return char, size


class Settings(NamedTuple):
    """What a model's file says about normalising texts before they are cut."""

    char_map: CharMap
    dummy_prefix: bool
    squeeze_spaces: bool
    escape_spaces: bool
    whole: tuple[bytes, ...]


def settings(model: bytes) -> Settings:
    spec, whole = b"", []
    for number, value in _fields(model):
        if number == 3:
            spec = value
        elif number == 1:
            piece = dict(_fields(value))
            if piece.get(3, 1) == 4:
                whole.append(piece[1])
    found = dict(_fields(spec))
    return Settings(
        CharMap(found.get(2, b"")),
        bool(found.get(3, 1)),
        bool(found.get(4, 1)),
        bool(found.get(5, 1)),
        tuple(sorted(whole, key=len, reverse=True)),
    )


def normalise(text: bytes, use: Settings) -> tuple[bytes, np.ndarray]:
    """The normal form, and for each of its bytes, and its end, the byte of `text` it is from.

    At each place the longest known prefix is replaced through the character map; texts
    of the model's own whole pieces stay as they are.
    """
    if not (use.squeeze_spaces or use.whole or len(use.char_map.units)):
        return _spaced(text, use)
    space = SPACE if use.escape_spaces else b" "
    parts, origin = [], []

    def put(data: bytes, at: int) -> None:
        parts.append(data)
        origin.extend([at] * len(data))

    def prefix(at: int) -> tuple[bytes, int]:
        for own in use.whole:
            if text.startswith(own, at):
                return own, len(own)
        return use.char_map.longest(text, at)

    at = 0
    if use.squeeze_spaces:
        while at < len(text):
            new, covered = prefix(at)
            if new != b" ":
                break
            at += covered
    if at == len(text):
        return b"", np.array([at])
    if use.dummy_prefix:
        put(space, at)
    after_space = use.squeeze_spaces
    while at < len(text):
        new, covered = prefix(at)
        if use.squeeze_spaces and after_space:
            new = new.lstrip(b" ")
        if new:
            put(new.replace(b" ", space), at)
            after_space = new.endswith(b" ")
        at += covered
    normal, end = b"".join(parts), at
    while use.squeeze_spaces and normal.endswith(space):
        normal = normal[: -len(space)]
        end = origin[len(normal)]
    return normal, np.array([*origin[: len(normal)], end])


def _spaced(text: bytes, use: Settings) -> tuple[bytes, np.ndarray]:
    """The same for models without a character map: only spaces change."""
    if not text:
        return b"", np.zeros(1, np.int64)
    space = SPACE if use.escape_spaces else b" "
    lead = space if use.dummy_prefix else b""
    widths = np.where(np.frombuffer(text, np.uint8) == 32, len(space), 1)
    origin = np.concatenate(
        [np.zeros(len(lead), np.int64), np.repeat(np.arange(len(text)), widths), [len(text)]]
    )
    return lead + text.replace(b" ", space), origin


def piece_widths(model) -> np.ndarray:
    """Bytes of the normal form that each id covers; -1 for ids that can stand for any."""
    widths = np.empty(model.get_piece_size(), np.int64)
    for i in range(len(widths)):
        odd = model.is_unknown(i) or model.is_control(i)
        widths[i] = -1 if odd else 1 if model.is_byte(i) else len(model.id_to_piece(i).encode())
    return widths


def own_widths(model, text: str, ids: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Bytes of the normal form that each id of a text covers.

    An unknown id stands for one character or a run of them; the model then tells the
    characters in place of a piece.
    """
    own = widths[ids]
    if (own < 0).any():
        told = model.encode(text, out_type=str)
        unknown = np.flatnonzero(own < 0)
        own[unknown] = [len(told[i].encode()) for i in unknown]
    return own


def spans(own: np.ndarray, normal: bytes, origin: np.ndarray) -> np.ndarray:
    """Start and end in the original bytes of each piece, from the widths of all."""
    ends = np.cumsum(own)
    if len(normal) != (ends[-1] if len(ends) else 0):
        raise ValueError("pieces do not cover the normal form")
    return np.stack([origin[ends - own], origin[ends]])


def _encoded(model_path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        use, widths = settings(model.serialized_model_proto()), piece_widths(model)
        for part in slices(batches, BATCH):
            texts = [t or "" for t in part.column(1).to_pylist()]
            coded = model.encode(texts, num_threads=1)
            plain = model.decode(coded, num_threads=1)
            ids, starts, ends = [], [], []
            for text, own in zip(texts, coded, strict=True):
                own = np.fromiter(own, np.int32, len(own))
                normal, origin = normalise(text.encode(), use)
                start, end = spans(own_widths(model, text, own, widths), normal, origin)
                ids.append(own)
                starts.append(start)
                ends.append(end)
            offsets = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))

            def lists(arrays: list[np.ndarray], offsets=offsets) -> pa.Array:
                return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays).astype(np.int32)))

            yield pa.record_batch(
                {
                    "key": part.column(0),
                    "ids": lists(ids),
                    "starts": lists(starts),
                    "ends": lists(ends),
                    "decoded": pa.array(plain, pa.string()),
                }
            )

    return run


def encode_pieces(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, starts, ends, decoded) for each row, as the model at `model_path` cuts it.

    The text is normalised by the longest prefixes of the model's compiled character map,
    with the origin of each byte on record; each piece's bytes in the normal form are then
    projected to the bytes [start, end) of the original UTF-8 text.  A piece of the space
    before the text has an empty span.  ids are the library's own, without begin or end;
    decoded is the text it makes of them.

    `model_path` must be readable on the executors.  A null text is empty: no ids and an
    empty decoded text.  Null and repeated keys are rows like others; an empty table gives
    an empty result; other columns are ignored.
    """
    kind = df.schema[key].dataType.simpleString()
    form = f"key {kind}, ids array<int>, starts array<int>, ends array<int>, decoded string"
    return df.select(key, text).mapInArrow(tidied(_encoded(model_path)), form).withColumnRenamed("key", key)
