import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import clashing, collected, documents, frame
from pyspark.sql import functions as F

from culprit.llm import near_vectors as vectors
from culprit.llm import ranked_search as search
from culprit.llm import spelling

# --- spelling variants ----------------------------------------------------------------


def lower_az(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    small, large = sorted((a, b), key=len)
    return any(large[:i] + large[i + 1 :] == small for i in range(len(large)))


def plain_words(rows):
    n = Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower_az(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def plain_spelling(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = sorted((-n[v], v) for v in near[w] if n[v] >= 10 * n[w])
        form[w] = best[0][1] if best else None
    made = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        made.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(made, key=repr)


def misspelt(seed=1):
    """Texts of frequent words, of which some occurrences carry an edit, and of hot prefixes."""
    draw = random.Random(seed)
    stems = ["therefore", "éternité", "Éternité", "aaaaaaaa", "aaaaaaab", "baaaaaaa", "streaming", "streamings", "x" * 300]
    words = []
    for stem in stems:
        words += [stem] * 130
        for _ in range(40):
            at = draw.randrange(len(stem))
            c = draw.choice("abxyzéÿ")
            words.append(draw.choice([stem[:at] + stem[at + 1 :], stem[:at] + c + stem[at:], stem[:at] + c + stem[at + 1 :]]))
    words += [f"common{a}{b}" for a in "abcdefgh" for b in "abcdefgh" for _ in range(2)]
    draw.shuffle(words)
    return [(i, " ".join(words[i::37]), "en", "a", 0) for i in range(37)] + [(None, "therefore THEREFORE", "en", "a", 0)] * 2


@pytest.mark.parametrize("list_pairs", [spelling.LIST_PAIRS, 50, 1])
def test_spelling_against_plain(spark, list_pairs):
    rows = misspelt() + documents()
    df = clashing(frame(spark, rows).repartition(3)).withColumns({"word": F.lit("own"), "form": F.lit("own"), "root": F.lit("own")})
    told = spelling.spelling_groups(df, list_pairs=list_pairs)
    assert collected(told) == plain_spelling(rows)


def test_spelling_follows_forms_to_the_last(spark):
    # Each step of the chain is one edit away and ten times as frequent.
    chain = [("abcdefg", 2), ("abcdefgh", 25), ("abcdefghi", 300), ("abcdefghix", 3500)]
    held = [(i, w) for w, n in chain for i in range(n)]
    rows = [(None, w, "en", "a", 0) for _, w in held]
    assert {w: n for w, n in plain_words(rows).items()} == dict(chain), "the null key must leave these words whole"
    told = {r["word"]: r for r in spelling.spelling_groups(frame(spark, rows)).collect()}
    assert {r["root"] for r in told.values()} == {"abcdefghix"}
    assert told["abcdefg"]["form"] == "abcdefgh" and told["abcdefghix"]["form"] is None


def test_spelling_flushes_and_empty(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    assert collected(spelling.spelling_groups(frame(spark, misspelt(2)))) == plain_spelling(misspelt(2))
    assert collected(spelling.spelling_groups(frame(spark, []))) == []


def test_chunks_meet_every_edit():
    for length in range(7, 12):
        word = "abcdefghijklmnop"[:length]
        half = length // 2
        for at in range(length + 1):
            longer = word[:at] + "z" + word[at:]
            assert longer[:half] == word[:half] or longer[half + 1 :] == word[half:]


# --- ranked search --------------------------------------------------------------------

TERM = re.compile(search.TERM)


def plain_terms(text):
    return TERM.findall(lower_az(text or ""))


def plain_search(rows, items, top=10):
    docs = [(key, Counter(plain_terms(text))) for key, text, *_ in rows]
    lengths = [sum(c.values()) for _, c in docs]
    n_docs, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    made = []
    for item, terms in asked.items():
        scored = []
        for (key, c), n in zip(docs, lengths, strict=True):
            m = 10 + (90 * n * n_docs) // max(total, 1)
            score = 0
            for t in terms:
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, key is None, key if key is not None else 0, key))
        for rank, (less, _, _, key) in enumerate(sorted(scored)[:top], 1):
            made.append((item, rank, key, -less))
    return sorted(made, key=repr)


def many_texts(seed=3, n=400):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the", "été", "日本"]
    rows = [(i, " ".join(draw.choices(words, k=draw.randrange(0, 40))), "en", "a", 0) for i in range(n)]
    # Copies whose scores tie beyond the last rank.
    return rows + [(1000 - i, "w1 w2 w3 w1", "en", "a", 0) for i in range(30)]


ITEMS = [
    (1, "W1 w2, w3!"),
    (2, "the the the"),
    (3, None),
    (4, ""),
    (5, "nothing-of-this is_there"),
    (6, " ".join(f"w{i}" for i in range(60))),
    (None, "été 日本 naïve"),
    (8, "quick"),
    (8, "brown fox"),
    (9, "w1 w2 w3"),
    (9, "w1 w2 w3"),
]


def items(spark, rows=None):
    df = spark.createDataFrame(ITEMS if rows is None else rows, "item_id long, text string")
    return df.withColumns({"term": F.lit("own"), "rank": F.lit(1), "score": F.lit(1), "item": F.lit(0)})


@pytest.mark.parametrize("pairs,block,first", [(search.PAIRS, search.BLOCK_DOCS, search.FIRST_READ), (20, 50, 2), (1, 7, 1)])
def test_search_against_plain(spark, monkeypatch, pairs, block, first):
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    monkeypatch.setattr(search, "FIRST_READ", first)
    rows = many_texts() + documents()
    df = clashing(frame(spark, rows).repartition(3)).withColumns({"item": F.lit("own"), "rank": F.lit("own"), "term": F.lit("own")})
    assert collected(search.ranked_search(df, items(spark), pairs=pairs)) == plain_search(rows, ITEMS)


def test_search_empty(spark):
    assert collected(search.ranked_search(frame(spark, []), items(spark))) == []
    assert collected(search.ranked_search(frame(spark), items(spark, []))) == []
    assert collected(search.ranked_search(frame(spark, [(1, None, "en", "a", 0)]), items(spark))) == []


def test_search_reads_no_further_than_it_must():
    """A document far ahead of all others is settled without the ends of the lists."""
    n = 5000
    impact = np.concatenate([[10**6], np.full(n - 1, 5)]).astype(np.int64)
    doc = np.arange(n, dtype=np.int32)
    lists = search.Lists(np.tile(doc, 2), np.tile(impact, 2), np.array([0, n]), np.array([n, 2 * n]), n)
    depths = []
    read = search.read_lists

    def counted(lists, terms, depth):
        depths.append(depth)
        return read(lists, terms, depth)

    search.read_lists = counted
    try:
        found, score = search.best_documents(lists, np.array([0, 1]), 1, 1.0)
    finally:
        search.read_lists = read
    assert found.tolist() == [0] and score.tolist() == [2 * 10**6] and depths == [search.FIRST_READ]


# --- nearest vectors ------------------------------------------------------------------

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_nearest(rows, every=50, top=5):
    made = {}
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], np.float32).astype(float)
    norm = np.sqrt((x * x).sum(1))
    for at, (i, v) in enumerate(zip(ids, x, strict=True)):
        if i % every == 0:
            score = (x * v).sum(1) / (norm * norm[at])
            order = sorted((-s, j) for s, j in zip(score, ids, strict=True) if j != i)[:top]
            made[i] = [(j, -s) for s, j in order]
    return made


def told_nearest(df):
    told = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(told.setdefault(r["query_id"], [])) + 1
        told[r["query_id"]].append((r["vec_id"], r["score"]))
    return told


def asked(df, **more):
    return vectors.nearest_vectors(df, F.col("id") % 50 == 0, **more)


@pytest.mark.parametrize("tree_rows", [vectors.TREE_ROWS, 100])
def test_nearest_recall(spark, folder, tree_rows):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want, told = plain_nearest(rows), told_nearest(asked(df, tree_rows=tree_rows))
    assert told.keys() == want.keys()
    hits = sum(len({j for j, _ in told[i]} & {j for j, _ in want[i]}) for i in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {(i, j): s for i in want for j, s in want[i]}
    for i, found in told.items():
        assert len(found) == 5 and i not in {j for j, _ in found}
        assert all(exact.get((i, j), s) == s for j, s in found)


def test_nearest_stops_early_on_clusters(monkeypatch):
    """Where neighbours are close, most leaves are never read, and recall holds."""
    draw = np.random.default_rng(5)
    centres = draw.standard_normal((100, 32))
    x = centres[np.arange(4000) % 100] + 0.05 * draw.standard_normal((4000, 32))
    tree = vectors.Tree(x, [[i] for i in range(4000)], axes := vectors.directions(32, 8, 17))
    reach, read, hits = vectors.radius(0.95, 8), 0, 0
    boxes = vectors.box_distance
    for q in range(0, 4000, 100):
        seen = []
        monkeypatch.setattr(vectors, "box_distance", lambda *a: (seen.append(1), boxes(*a))[1])
        found = {i for _, i in tree.nearest(x[q], axes, 6, math.inf, reach)}
        cosine = (x @ x[q]) / np.sqrt((x * x).sum(1))
        hits += len(found & set(np.argsort(-cosine)[:6].tolist()))
        read += len(seen)
    assert hits >= 0.9 * 40 * 6
    assert read < 0.5 * 40 * len(tree.nodes)


def test_chi_square():
    # Fixed values of the distribution with eight degrees of freedom.
    assert vectors.radius(0.95, 8) == pytest.approx(15.5073, abs=1e-4)
    assert vectors.radius(0.5, 8) == pytest.approx(7.3441, abs=1e-4)


def awkward():
    draw = np.random.default_rng(9)
    rows = [(i, draw.standard_normal(6).tolist(), 0) for i in range(60, 300)]
    copy = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    # Copies beyond what a tree keeps, among them queries; a scaled one; one vector twice.
    rows += [(i, copy, 1) for i in range(1000, 1200)] + [(1300, [2 * x for x in copy], 1)] * 2
    bad = [
        (400, None, 0),
        (450, [], 0),
        (500, [0.0] * 6, 0),
        (550, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0),
        (600, [1.0, math.nan, 1.0, 1.0, 1.0, 1.0], 0),
        (650, [1.0, math.inf, 1.0, 1.0, 1.0, 1.0], 0),
        (700, [1.0, 2.0], 0),
        (None, copy, 0),
    ]
    return rows, bad


@pytest.mark.parametrize("tree_rows,queries", [(vectors.TREE_ROWS, vectors.TREE_QUERIES), (40, 2)])
def test_nearest_awkward_rows(spark, monkeypatch, tree_rows, queries):
    monkeypatch.setattr(vectors, "TREE_QUERIES", queries)
    rows, bad = awkward()
    df = spark.createDataFrame(rows + bad, SCHEMA).withColumns(
        {c: F.lit(f"own {c}") for c in ("id", "vec", "node", "rank", "score", "cell", "part", "query_id", "ids", "far")}
    )
    told = told_nearest(vectors.nearest_vectors(df.repartition(3), F.col("id") % 50 == 0, sure=1 - 1e-12, tree_rows=tree_rows))
    want = plain_nearest(list({i: (i, v) for i, v, _ in rows}.values()))
    assert told.keys() == want.keys()
    for i in want:
        assert [j for j, _ in told[i]] == [j for j, _ in want[i]], i
        assert [s for _, s in told[i]] == [s for _, s in want[i]], i


def test_nearest_few_and_empty(spark):
    few = spark.createDataFrame([(50, [1.0, 0.0], 0), (7, [1.0, 1.0], 0), (50, [5.0, 0.0], 0)], SCHEMA)
    told = told_nearest(asked(few))
    assert told.keys() == {50} and [j for j, _ in told[50]] == [7]
    assert told[50][0][1] == pytest.approx(math.sqrt(0.5))
    assert collected(asked(spark.createDataFrame([], SCHEMA))) == []
    assert collected(asked(spark.createDataFrame([(50, None, 0)], SCHEMA))) == []
    assert collected(asked(spark.createDataFrame([(50, [1.0], 0)], SCHEMA))) == []
