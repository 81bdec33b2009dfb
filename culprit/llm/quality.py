"""Quality rules: document statistics, and boosted trees over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from culprit.llm.shared import slices, tidied

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

# The base rule: too short, or mostly repeated.
LEAST_WORDS = 50
MOST_REPEATED = 50

# Labelled documents that the trees are fitted on, at most.
SAMPLE_ROWS = 20_000

# Statistics that the trees see, and the direction in which the score may move with each:
# -1 never up, 1 never down, 0 free.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_ratio": -1,
    "dup_line_ratio": -1,
    "repeat_ratio": -1,
    "upper_ratio": 0,
    "digit_ratio": 0,
    "punctuation_ratio": 0,
    "line_words": 0,
    "long_word_ratio": 0,
    "distinct_ratio": 0,
}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_MIX = tuple(
    np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
)


def repeated_words(words: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more, from hashes of the words."""
    if len(words) < 4:
        return 0
    windows = (words[:-2] * _MIX[0]) ^ (words[1:-1] * _MIX[1] + (words[2:] * _MIX[2] >> np.uint64(7)))
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(words), bool)
    for at in range(3):
        covered[at : at + len(windows)] |= twice
    return int(covered.sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The counts of `COUNTS` and the values of `FEATURES` of a text."""
    words = text.encode().split()
    n = len(words)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(hashes)
    some = max(n, 1)
    many = max(chars, 1)
    widths = np.fromiter(map(len, words), np.int64, n)
    ascii_bytes = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=128)
    features = [
        np.log1p(n),
        chars / some,
        symbols / some,
        dup_lines / max(len(lines), 1),
        repeats / some,
        ascii_bytes[65:91].sum() / many,
        ascii_bytes[48:58].sum() / many,
        sum(map(text.count, ".,;:!?")) / some,
        n / max(len(lines), 1),
        float((widths > 20).sum()) / some,
        len(np.unique(hashes)) / some,
    ]
    return [n, chars, symbols, dup_lines, repeats], features


class Trees(NamedTuple):
    """Boosted trees as flat node arrays: one row per tree, nodes in heap order.

    Node i has its children at 2i+1 (value <= threshold) and 2i+2.  A node that does not
    split sends all rows left, so every row ends at the same depth.
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The fitted probability for each row of `x`."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = x[rows, feature[node]] > threshold[node]
                node = 2 * node + 1 + right
            total += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    directions: np.ndarray,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    ridge: float = 1.0,
    least: int = 20,
) -> Trees:
    """Trees fitted to 0/1 labels by second-order boosting over binned features.

    A split on a feature with a direction must order its sides' values accordingly, and
    the values below both sides are then held on either side of the middle, so that the
    sum of all trees is monotone in that feature.
    """
    inner, leaves = 2**depth - 1, 2**depth
    rate_up = np.clip(y.mean() if len(y) else 0.9, 1e-3, 1 - 1e-3)
    start = float(np.log(rate_up / (1 - rate_up)))
    model = Trees(
        np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), start, depth
    )
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)])
    total = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, bend = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        low, high = {0: -np.inf}, {0: np.inf}
        for i in range(inner):
            mine = np.flatnonzero(node == i)
            lo, hi = low[i], high[i]
            best = (1e-6, None)
            if len(mine) >= 2 * least:
                g, h = slope[mine].sum(), bend[mine].sum()
                value = np.clip(-g / (h + ridge), lo, hi)
                own = g * value + 0.5 * (h + ridge) * value**2
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    of = binned[f, mine]
                    gs = np.cumsum(np.bincount(of, slope[mine], len(c) + 1))[:-1]
                    hs = np.cumsum(np.bincount(of, bend[mine], len(c) + 1))[:-1]
                    ns = np.cumsum(np.bincount(of, minlength=len(c) + 1))[:-1]
                    a = np.clip(-gs / (hs + ridge), lo, hi)
                    b = np.clip(-(g - gs) / (h - hs + ridge), lo, hi)
                    gain = own - (
                        gs * a + 0.5 * (hs + ridge) * a**2 + (g - gs) * b + 0.5 * (h - hs + ridge) * b**2
                    )
                    gain[(ns < least) | (len(mine) - ns < least) | (directions[f] * (b - a) < 0)] = -np.inf
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (gain[at], (f, at, a[at], b[at]))
            left, right = 2 * i + 1, 2 * i + 2
            low[left], high[left], low[right], high[right] = lo, hi, lo, hi
            if best[1] is None:
                node[mine] = left
                continue
            f, at, a, b = best[1]
            model.feature[t, i], model.threshold[t, i] = f, cuts[f][at]
            node[mine] = np.where(binned[f, mine] > at, right, left)
            if directions[f]:
                middle = (a + b) / 2
                upper, lower = (right, left) if directions[f] > 0 else (left, right)
                low[upper], high[lower] = middle, middle
        end = node - inner
        g = np.bincount(end, slope, leaves)
        h = np.bincount(end, bend, leaves)
        lows = np.array([low[inner + j] for j in range(leaves)])
        highs = np.array([high[inner + j] for j in range(leaves)])
        model.leaf[t] = rate * np.clip(-g / (h + ridge), lows, highs)
        total += model.leaf[t][end]
    return model


def _measured(
    model: Trees | None, cut: float, carried: int = 0
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            told = [statistics(t.as_py() or "") for t in batch.column(1)]
            counts = np.array([c for c, _ in told], np.int64).reshape(-1, len(COUNTS))
            x = np.array([f for _, f in told]).reshape(-1, len(FEATURES))
            made = {"key": batch.column(0)}
            made |= {name: pa.array(counts[:, i]) for i, name in enumerate(COUNTS)}
            if model is None:
                made |= {name: pa.array(x[:, i]) for i, name in enumerate(FEATURES)}
            else:
                n, repeats = counts[:, 0], counts[:, 4]
                failed = (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n)
                score = model.score(x)
                made |= {
                    "base_failed": pa.array(failed),
                    "score": pa.array(score),
                    "kept": pa.array(~failed & (score >= cut)),
                }
            made |= {f"carried{i}": batch.column(2 + i) for i in range(carried)}
            yield pa.record_batch(made)

    return run


def document_statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the counts and the features of each row's text; a null text has no words."""
    kind = df.schema[key].dataType.simpleString()
    form = ", ".join(
        [f"key {kind}", *(f"{c} long" for c in COUNTS), *(f"{f} double" for f in FEATURES)]
    )
    return df.select(key, text).mapInArrow(tidied(_measured(None, 0)), form).withColumnRenamed("key", key)


def fit_quality(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 3,
) -> Trees:
    """Trees fitted on a sample of labelled rows, of `sample_rows` rows at most.

    The sample is the first rows by a seeded hash of the key, the same on every run; its
    keys are so few that they may be broadcast, and only its statistics reach the driver.
    Of rows that repeat a key, the text of the smallest hash and its smallest label count.
    Rows without key or label are left out.  Without labels the trees say nothing: every
    score is the same, and it is above one half.
    """
    sample = (
        labels.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_label"))
        .dropna()
        .orderBy(F.xxhash64(F.lit(seed), "_key"), "_key", "_label")
        .limit(sample_rows)
    )
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), "_key")
    # One text a key, so that a key with many rows does not outgrow the sample.
    rows = rows.groupBy("_key").agg(F.min(F.struct(F.xxhash64("_text"), "_text", "_label")).alias("_one"))
    # The label rides along in the key, as statistics keep one column beside the text.
    keyed = rows.select(F.struct("_key", "_one._label").alias("_pair"), "_one._text")
    told = document_statistics(keyed, "_pair", "_text").select("_pair._label", *FEATURES).toPandas()
    x, y = told[list(FEATURES)].to_numpy(float), told["_label"].to_numpy(float)
    order = np.lexsort((*x.T, y))
    directions = np.array(list(FEATURES.values()))
    if not len(y):
        x, y = np.zeros((0, len(FEATURES))), np.zeros(0)
    return fit_trees(x[order], y[order], directions)


def quality_rules(
    df: DataFrame,
    model: Trees,
    key: str = "doc_id",
    text: str = "text",
    cut: float = 0.5,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """key, counts, base_failed, score and kept for each row, and its columns in `carry`.

    Words are separated by ASCII white space.  A text fails the base rule with fewer than
    50 words, or when more than half of its words lie in 3-word windows that occur twice
    or more in it.  Others are kept when their score is `cut` or more; the score never
    rises with symbols per word, repeated lines or repeated words.  The model's node
    arrays travel with the task; texts are scored a batch at a time.

    A null or empty text has no words and fails.  Null and repeated keys are rows like
    others; an empty table gives an empty result; other columns are ignored.
    """
    kind = df.schema[key].dataType.simpleString()
    form = ", ".join(
        [
            f"key {kind}",
            *(f"{c} long" for c in COUNTS),
            "base_failed boolean, score double, kept boolean",
            *(f"carried{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)),
        ]
    )
    rows = df.select(key, text, *(F.col(c).alias(f"carried{i}") for i, c in enumerate(carry)))
    told = rows.mapInArrow(tidied(_measured(model, cut, len(carry))), form)
    return told.withColumnsRenamed({"key": key} | {f"carried{i}": c for i, c in enumerate(carry)})
