import hashlib
from itertools import combinations

from cases import clashing, collected, documents, frame, words

from culprit.llm import exact_dedup as exact
from culprit.llm import ngram_join as join
from culprit.llm.components import components


def plain_copies(rows):
    groups = {}
    for at, (key, text, *_) in enumerate(rows):
        bare = "".join(words(text))
        groups.setdefault(bare, []).append((-len(text or ""), key is None, key or 0, at, key))
    made = []
    for bare, members in groups.items():
        keeper = min(members, key=lambda m: (m[0], m[1], m[2]))
        digest = hashlib.sha256(bare.encode()).hexdigest()
        twins = [m for m in members if (m[0], m[4]) == (keeper[0], keeper[4])]
        made += [(m[4], keeper[4], len(members), m is twins[0], digest) for m in members]
    return sorted(made, key=repr)


def test_exact_dedup_against_plain(spark):
    assert collected(exact.exact_dedup(frame(spark))) == plain_copies(documents())


def test_exact_dedup_many_runs_and_clashes(spark):
    rows = documents() * 3
    df = clashing(frame(spark, rows).repartition(40))
    got = exact.exact_dedup(df).drop("kept")
    want = sorted(((a, b, c, e) for a, b, c, _, e in plain_copies(rows)), key=repr)
    assert collected(got) == want
    kept = exact.exact_dedup(df).where("kept")
    assert kept.count() == kept.select("text_sha256").distinct().count()


def test_exact_dedup_keeps_equal_digests_with_other_checks_apart(spark):
    rows = [(0, b"d", 1, 4, 1), (1, b"d", 2, 4, 2), (2, b"d", 1, 4, 3)]
    runs = spark.createDataFrame(rows, "run int, digest binary, check long, length int, keeper long").selectExpr(
        "*", "1L as size"
    )
    got = exact.merge_runs(runs, 1).select("check", "keeper", "size")
    assert collected(got) == [(1, 1, 2), (2, 2, 1)]


def test_exact_dedup_empty(spark):
    assert collected(exact.exact_dedup(frame(spark, []))) == []


def plain_sets(rows, width=4):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for key, text, *_ in rows:
        own = words((text or "").translate(lower))
        grams = {tuple(own[i : i + width]) for i in range(len(own) - width + 1)}
        sets.append((key, grams or ({tuple(own)} if own else set())))
    return sets


def plain_join(rows):
    sets = plain_sets(rows)
    root = {key: key for key, _ in sets if key is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if None not in (a, b) and s and t and 100 * len(s & t) >= 85 * len(s | t):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return sorted(((k, len(s), None if k is None else find(k)) for k, s in sets), key=repr)


def test_ngram_join_against_plain(spark):
    assert collected(join.ngram_join(frame(spark))) == plain_join(documents())


def chain(n=60, size=120):
    """Texts that each share all but a few words with the next, and an unlike half."""
    made = []
    for i in range(n):
        text = [f"t{j}" for j in range(i * 2, i * 2 + size)]
        made.append((1000 - i, " ".join(text), "en", "s", 0))
        made.append((2000 + i, " ".join(f"u{i}x{j}" for j in range(size)), "en", "s", 0))
    return made


def test_ngram_join_chain_links_through(spark):
    rows = chain()
    got = collected(join.ngram_join(clashing(frame(spark, rows).repartition(7))))
    assert got == plain_join(rows)
    assert min(c for k, _, c in got if k <= 1000) == 941


def test_ngram_join_group_with_many_edits_in_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(join, "MEMBERS", 8)
    draw = random.Random(5)
    base = [f"b{j}" for j in range(150)]
    rows = []
    for i in range(80):
        own = list(base)
        for at in draw.sample(range(150), draw.randrange(0, 9)):
            own[at] = f"e{i}x{at}"
        rows.append((i, " ".join(own), "en", "s", 0))
    assert collected(join.ngram_join(frame(spark, rows * 2).repartition(5))) == plain_join(rows * 2)


def test_ngram_join_goes_through_a_key_with_two_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    alone = " ".join(f"c{i}" for i in range(60))
    rows = [(3, one), (5, one + " x"), (5, two), (9, two + " y"), (12, alone), (5, None), (12, ""), (14, None)]
    rows = [(k, t, "en", "s", 0) for k, t in rows]
    got = collected(join.ngram_join(frame(spark, rows)))
    assert got == plain_join(rows)
    assert {(k, c) for k, _, c in got} == {(3, 3), (5, 3), (9, 3), (12, 12), (14, 14)}


def test_ngram_join_empty(spark):
    assert collected(join.ngram_join(frame(spark, []))) == []


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, j) for j in range(8, 60)] + [(3, 3)]
    got = dict(collected(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {i: 100 for i in range(101, 141)} | {j: 7 for j in range(8, 60)}
