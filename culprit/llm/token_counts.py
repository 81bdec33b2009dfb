"""Token counts of texts, by counting each distinct pre-token once."""

from __future__ import annotations

import os
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culprit.llm.shared import stored, tidied

# Fixed value: how byte-level vocabularies of this family cut a text into pre-tokens.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Characters on whose classes the regular-expression module and the tokenizer library
# agree; the two know different versions of Unicode.  Texts with others are cut by the
# library itself, which takes longer and gives the same form.
AGREED = (
    r"[\x00-\u0557\u0590-\u0870\u1E00-\u2070\u20A0-\u9FFF\uAC00-\uD7A3\uF900-\uFFFF"
    r"\U0001F000-\U0001FAFF\U00020000-\U0002A6DF]*+"
)

# Texts that share one vocabulary of pre-tokens on their way to the counts.
BLOCK_CHARS = 16_000_000

# Counts that go back to their blocks in one packet per block.
PACKED_ROWS = 500_000


def planes(values: np.ndarray) -> bytes:
    """Small integers, byte by byte of equal weight, compressed."""
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unplanes(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def check_kind(path: str) -> None:
    """Only tokenizers whose pre-tokens depend on nothing outside them can be split up."""
    import json

    tokenizer = json.loads(load(path).to_str())
    cut = tokenizer["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    if tokenizer["normalizer"] is not None or not plain:
        raise ValueError("a byte-level tokenizer without normaliser is needed")


def splitter(path: str) -> Callable[[str], tuple[list[str], int]]:
    """Pre-tokens of a text, and how many tokens the special strings in it make."""
    import regex

    tokenizer = load(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    agreed, split = regex.compile(AGREED), regex.compile(SPLIT)

    def cut(text: str) -> tuple[list[str], int]:
        if any(s in text for s in special):
            # Special strings may take white space beside them, so the library counts.
            return [], len(tokenizer.encode(text, add_special_tokens=False).ids)
        if agreed.fullmatch(text):
            return split.findall(text), 0
        return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)], 0

    return cut


def _blocks(path: str, block_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, part, made = splitter(path), TaskContext.get().partitionId(), 0

        def emit() -> pa.RecordBatch:
            nonlocal made
            made += 1
            table = [planes(np.array(lengths)), planes(np.concatenate(slots or [[]])), planes(np.concatenate(times or [[]]))]
            return pa.record_batch(
                {
                    "block": pa.array([(part << 32) + made], pa.int64()),
                    "ids": pa.array([pa.array(ids, ids_type)], pa.list_(ids_type)),
                    "n_bytes": pa.array([n_bytes], pa.list_(pa.int64())),
                    "direct": pa.array([direct], pa.list_(pa.int64())),
                    "pieces": pa.array([list(vocabulary)], pa.list_(pa.string())),
                    "lengths": pa.array([table[0]], pa.binary()),
                    "slots": pa.array([table[1]], pa.binary()),
                    "times": pa.array([table[2]], pa.binary()),
                }
            )

        def fresh():
            vocabulary = defaultdict()
            vocabulary.default_factory = vocabulary.__len__
            return [], [], [], [], [], [], vocabulary, 0

        ids, n_bytes, direct, lengths, slots, times, vocabulary, chars = fresh()
        for batch in batches:
            ids_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                pieces, counted = cut(text)
                found = Counter(pieces)
                slot = np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found))
                order = np.argsort(slot)
                ids.append(key.as_py())
                n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                direct.append(counted)
                lengths.append(len(found))
                slots.append(np.diff(slot[order], prepend=0))
                times.append(np.fromiter(found.values(), np.int64, len(found))[order])
                chars += len(text)
                if chars >= block_chars:
                    yield emit()
                    ids, n_bytes, direct, lengths, slots, times, vocabulary, chars = fresh()
        if ids:
            yield emit()

    return run


def _pieces(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (piece, block, slot), sorted by piece, to the slots' counts, packed by block."""

    def packed(block: np.ndarray, slot: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((slot, block))
        block, slot, n = block[order], slot[order], n[order]
        starts = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
        ends = [*starts[1:], len(block)]
        return pa.record_batch(
            {
                "block": pa.array(block[starts]),
                "slots": pa.array(
                    [planes(np.diff(slot[x:y], prepend=0)) for x, y in zip(starts, ends, strict=True)], pa.binary()
                ),
                "counts": pa.array([planes(n[x:y]) for x, y in zip(starts, ends, strict=True)], pa.binary()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        last, last_n, held, rows = None, 0, [], 0
        for batch in batches:
            runs = pc.run_end_encode(batch.column(0))
            distinct = runs.values.to_pylist()
            if not distinct:
                continue
            # The first may go on from the batch before.
            skip = int(distinct[0] == last)
            new = tokenizer.encode_batch_fast(distinct[skip:], add_special_tokens=False)
            n = np.array([last_n] * skip + [len(e.ids) for e in new], np.int64)
            n_rows = np.repeat(n, np.diff(np.array(runs.run_ends), prepend=0))
            held.append((batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64), n_rows))
            last, last_n, rows = distinct[-1], int(n[-1]), rows + batch.num_rows
            if rows >= PACKED_ROWS:
                yield packed(*map(np.concatenate, zip(*held, strict=True)))
                held, rows = [], 0
        if held:
            yield packed(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _summed(counts: pa.Table, tables: pa.Table) -> pa.Table:
    """Tokens per document of one block: frequencies times pieces."""
    at = {name: tables[name][0] for name in tables.column_names}
    lengths = unplanes(at["lengths"].as_py())
    steps, times = unplanes(at["slots"].as_py()), unplanes(at["times"].as_py())
    ends = np.cumsum(lengths)
    # Slots are stored as steps within a document: undo the sum over those before.
    run = np.cumsum(steps)
    slots = run - np.repeat(np.concatenate([[0], run])[ends - lengths], lengths)
    pieces = np.zeros(slots.max(initial=-1) + 1, np.int64)
    for some, n in zip(counts["slots"].to_pylist(), counts["counts"].to_pylist(), strict=True):
        pieces[np.cumsum(unplanes(some))] = unplanes(n)
    sums = np.concatenate([[0], np.cumsum(pieces[slots] * times)]).astype(np.int64)
    total = sums[ends] - sums[ends - lengths] + np.array(at["direct"].as_py(), np.int64)
    return pa.table({"id": at["ids"].values, "n_bytes": at["n_bytes"].values, "n_tokens": pa.array(total)})


def token_counts(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(key, n_bytes, n_tokens) for each row, as the tokenizer file at `path` counts.

    Byte-level tokenizers encode every pre-token by itself, so a text has as many tokens
    as its pre-tokens have pieces.  A block of texts keeps how often each text holds each
    pre-token; the blocks' pre-tokens meet by value, each distinct one is encoded once,
    and its number of pieces goes back to the blocks that hold it and is summed there.
    No ids leave the encoder.  A pre-token that is in every text comes once per block.

    `path` must be readable on the executors.  Texts count without begin, end or padding;
    special strings inside them count as the library's default takes them.  A null text
    is empty and has no tokens.  Null and repeated keys are rows like others; an empty
    table gives an empty result; other columns are ignored.
    """
    check_kind(path)
    kind = df.schema[key].dataType.simpleString()
    form = (
        f"block long, ids array<{kind}>, n_bytes array<long>, direct array<long>, "
        "pieces array<string>, lengths binary, slots binary, times binary"
    )
    blocks = stored(df.select(key, text).mapInArrow(tidied(_blocks(path, block_chars)), form), "pre-tokens")
    pieces = (
        blocks.select("block", F.posexplode("pieces").alias("slot", "piece"))
        .select("piece", "block", "slot")
        .repartition("piece")
        .sortWithinPartitions("piece")
    )
    counts = pieces.mapInArrow(tidied(_pieces(path)), "block long, slots binary, counts binary")
    return (
        counts.groupBy("block")
        .cogroup(blocks.drop("pieces").groupBy("block"))
        .applyInArrow(_summed, f"id {kind}, n_bytes long, n_tokens long")
        .withColumnRenamed("id", key)
    )
