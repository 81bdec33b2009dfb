"""The pipeline's stages, each on its own input, against plain versions."""

import random
from collections import Counter

import corpus_pipeline as pipeline
import pytest
from cases import SCHEMA, collected, words
from test_dedup_ops import plain_join, plain_sets
from test_mix_ops import plain_lines, plain_targets
from test_text_ops import plain_counts, plain_pieces

from culprit.llm import quality


def corpus():
    draw = random.Random(9)
    rows, labels = [], []
    for i in range(160):
        body = [f"{draw.choice('abcdefgh')}{draw.randrange(900)}" for _ in range(draw.randrange(20, 160))]
        lines = [" ".join(body[j : j + 12]) for j in range(0, len(body), 12)]
        if i % 4 == 0:
            lines.insert(0, "all rights reserved by this source")
        if i % 7 == 0:
            lines = [x.replace(" ", "### ") for x in lines]
        rows.append([i, "\n".join(lines), "en", f"src{i % 3}", 0])
        labels.append((i, int(i % 7 != 0), 0))
    for i in range(12):
        rows.append([200 + i, rows[3 + i][1] + " tail", "en", "src0", 0])
    rows += [[300, None, None, None, None], [301, "", "en", "src1", 0], [302, "short", "en", "src1", 5]]
    rows = [tuple([*r[:4], None if r[1] is None else len(r[1])]) for r in rows]
    return rows, labels


@pytest.fixture(scope="module")
def folder_of(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    return str(folder)


@pytest.fixture(scope="module")
def kept(spark, folder_of, tmp_path_factory):
    """The rows before the first and after each stage."""
    docs, made = spark.read.parquet(f"{folder_of}/documents.parquet"), []
    root = tmp_path_factory.mktemp("stages")
    made.append(docs)
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder_of).write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
        made.append(docs)
    return made


def test_stages_return_documents(kept):
    assert all(tuple(df.columns) == pipeline.COLUMNS for df in kept[:-1])


def test_quality_stage(spark, kept, folder_of):
    model = quality.fit_quality(kept[0], spark.read.parquet(f"{folder_of}/labels.parquet"))
    want = []
    for row in kept[0].collect():
        n, *_, repeats = plain_counts(row.text)
        _, features = quality.statistics(row.text or "")
        good = n >= 50 and 100 * repeats <= 50 * n
        if good and model.score(quality.np.array([features]))[0] >= 0.5:
            want.append(tuple(row))
    assert collected(kept[1]) == sorted(want, key=repr)
    assert 60 < len(want) < 150 and not any("###" in w[1] for w in want)


def test_quality_stage_judges_rows_of_one_key_apart(spark, folder_of):
    rows, _ = corpus()
    good = [r for r in rows if r[0] % 7 and len(words(r[1])) >= 60][:4]
    bad = [(None, "short", "en", "s", 5), (7000, None, None, None, None), (7000, "a b " * 90, "en", "s", 360)]
    mixed = [*bad, *((key, *r[1:]) for key in (None, 7000) for r in good), (None, *good[0][1:])]
    docs = spark.createDataFrame(rows + mixed, SCHEMA).repartition(3)
    model = quality.fit_quality(docs, spark.read.parquet(f"{folder_of}/labels.parquet"))
    want = []
    for row in rows + mixed:
        n, *_, repeats = plain_counts(row[1])
        good_score = model.score(quality.np.array([quality.statistics(row[1] or "")[1]]))[0] >= 0.5
        if n >= 50 and 100 * repeats <= 50 * n and good_score:
            want.append(row)
    assert collected(pipeline.quality(spark, docs, folder_of)) == sorted(want, key=repr)
    assert sum(r[0] is None for r in want) > 1 and sum(r[0] == 7000 for r in want) > 1


def test_line_stage(kept):
    rows = kept[1].collect()
    told = plain_lines([(r.source, r.text) for r in rows], pipeline.LINE_RATIO, pipeline.LEAST_DOCS)
    want = sorted((s, t) for s, t, _, _ in told)
    assert sorted((r.source, r.text) for r in kept[2].collect()) == want
    assert any("all rights" in r.text for r in rows)
    assert not any("all rights" in r.text for r in kept[2].collect())
    assert all(r.n_chars == len(r.text) for r in kept[2].collect())


def test_near_copy_stage(kept):
    rows = [tuple(r) for r in kept[2].collect()]
    roots = {key: root for key, _, root in plain_join(rows)}
    assert collected(kept[3]) == sorted((r for r in rows if roots[r[0]] == r[0]), key=repr)
    assert kept[3].count() < len(rows)


def copies_left(rows):
    """The rows that a brute-force join of 5-word grams at 0.8 leaves."""
    sets, group = plain_sets(rows, 5), list(range(len(rows)))
    for a, (_, s) in enumerate(sets):
        for b, (_, t) in enumerate(sets[:a]):
            if s and t and 5 * len(s & t) >= 4 * len(s | t) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    first = {}
    for at, row in enumerate(rows):
        rank = (row[0] is None, row[0] or 0, at)
        first[group[at]] = min(first.get(group[at], rank), rank)
    return sorted((rows[rank[2]] for rank in first.values()), key=repr)


def test_near_copy_stage_takes_five_words_and_four_fifths(spark, kept):
    draw = random.Random(4)
    base = [f"b{j}" for j in range(1000)]
    edited = [w if at % 47 else f"e{at}" for at, w in enumerate(base)]
    far = [w if at % 40 else f"f{at}" for at, w in enumerate(base)]
    texts = [base, base + [f"n{j}" for j in range(200)], edited, far, [draw.choice("xyz") for _ in range(60)]]
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)]
    got = collected(pipeline.near_copies(spark, spark.createDataFrame(rows, SCHEMA), ""))
    assert got == copies_left(rows)
    assert [r[0] for r in got] == [0, 3, 4]
    assert collected(kept[3]) == copies_left([tuple(r) for r in kept[2].collect()])


def test_near_copy_stage_judges_rows_of_one_key_apart(spark):
    one, two, alone = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(3, one), (5, one + " x"), (5, alone), (None, two), (None, two), (7, two + " y"), (None, None), (None, None)]
    rows += [(8, "few words"), (8, "few words"), (9, ""), (9, None), (None, alone + " z")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], SCHEMA).repartition(3)
    got = sorted(((r[0], r[1]) for r in collected(pipeline.near_copies(spark, docs, ""))), key=repr)
    want = [(3, one), (5, alone), (7, two + " y"), (None, None), (8, "few words"), (9, ""), (9, None)]
    assert got == sorted(want, key=repr)


def test_mixture_stage(kept):
    rows = kept[3].collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    want, largest = plain_targets(sizes), max(len(words(r.text)) for r in rows)
    got = kept[4].collect()
    for source, target in want.items():
        taken = sum(len(words(r.text)) for r in got if r.source == source)
        assert abs(taken - target) <= largest / 2
    known = {tuple(r) for r in rows}
    assert {tuple(r) for r in got} <= known
    assert max(sum(g == r for g in got) for r in rows) <= 2


def test_mixture_stage_takes_better_scored_rows(spark, tmp_path):
    """What a source is taken beyond a whole epoch is of the kind that scores higher."""
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        text = " ".join(f"{draw.choice('abcdefgh')}{draw.randrange(9000)}" for _ in range(80))
        text = text.replace(" ", " # ") if i % 2 else text
        rows += [(i + at, text, "en", source, len(text)) for at, source in ((0, "s0"), (1000, "s1"), (2000, "s0"))]
        labels.append((i, 1 - i % 2, 0))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = [r for r in pipeline.mixture(spark, docs, str(tmp_path)).collect() if r.source == "s1"]
    taken = Counter(r.doc_id for r in got)
    assert set(taken.values()) == {1, 2} and len(taken) == 400  # one epoch and a part of a second
    good, bad = (sum(n == 2 and k % 2 == odd for k, n in taken.items()) for odd in (0, 1))
    assert good > 3 * bad


def test_piece_stage_and_run(spark, kept, folder_of):
    rows = [tuple(r) for r in kept[4].collect()]
    assert collected(kept[5].select("doc_id", "ids", "decoded")) == plain_pieces(rows)
    assert collected(pipeline.run(spark, folder_of)) == collected(kept[5])


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
