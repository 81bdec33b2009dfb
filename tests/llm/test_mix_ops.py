import zlib
from collections import Counter

import pytest
from cases import clashing, collected, documents, frame, words

from culprit.llm import line_dedup as lines
from culprit.llm import mixing, sharding
from pyspark.sql import functions as F


def source_rows(counts, text=lambda i: "w " * (1 + i * 7 % 50)):
    made, key = [], 0
    for source, n in counts.items():
        for _ in range(n):
            made.append((key, text(key), "en", source, 0))
            key += 1
    return made


def plain_targets(sizes, turn=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: turn[i % len(turn)] for i, s in enumerate(names)}
    left, open_names, target = share * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in open_names)
        full = [s for s in open_names if left * weight[s] / total > most * sizes[s]]
        if not full:
            return target | {s: left * weight[s] / total for s in open_names}
        for s in full:
            target[s] = most * sizes[s]
            open_names.discard(s)
        left = share * sum(sizes.values()) - sum(target.values())


@pytest.mark.parametrize(
    "counts",
    [{"a": 300, "b": 20, "c": 60, None: 40}, {"a": 5}, {"a": 10, "b": 10, "c": 10, "d": 500, "e": 1, "Z": 3}],
)
def test_mix_targets_and_takes(spark, counts):
    rows = source_rows(counts)
    mixed = mixing.mix(clashing(frame(spark, rows).repartition(5)), F.lit(0.7), F.expr("size(split(trim(text), ' '))"))
    got = mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(words(text))
    want, largest = plain_targets(sizes), max(r.size for r in got)
    assert len(got) == len(rows)
    for source in sizes:
        own = [r for r in got if r.source == source]
        assert {r.source_size for r in own} == {sizes[source]}
        assert all(abs(r.target - want[source]) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - want[source]) <= largest / 2
        assert len({r.copies for r in own}) <= 2
    assert all(r.taken == r.copies * r.size <= 2 * r.size for r in got)


def test_mix_order_is_that_of_the_keys(spark):
    import hashlib
    import math

    rows = source_rows({"a": 200, "b": 200, "c": 200})
    weight = F.when(F.col("doc_id") % 3 == 0, 0.2).otherwise(1.0)
    got = {r.doc_id: r for r in mixing.mix(frame(spark, rows), weight, F.expr("size(split(trim(text), ' '))")).collect()}
    for source in "abc":
        keyed = []
        for key, text, _, own, _ in rows:
            if own == source:
                size = len(words(text))
                top = int(hashlib.md5(f"11:{key}:{size}".encode()).hexdigest()[:13], 16)
                u = (top + 0.5) / 2**52
                keyed.append((-math.log(u) / (0.2 if key % 3 == 0 else 1.0), key, size))
        first = got[keyed[0][1]]
        whole = int(first.target // first.source_size)
        rest, ahead = first.target - whole * first.source_size, 0
        for _, key, size in sorted(keyed):
            assert got[key].copies == whole + (rest > 0 and ahead + size / 2 <= rest)
            ahead += size


def test_mix_odd_rows_reruns_and_draws(spark):
    df = frame(spark, documents()).withColumn("w", F.when(F.col("doc_id") > 5, F.lit(float("nan"))))
    size = F.size(F.split("text", " "))
    mixed = mixing.mix(df, F.col("w"), size).drop("w")
    assert collected(mixed) == collected(mixing.mix(df.repartition(9), F.col("w"), size).drop("w"))
    assert mixed.count() == len(documents())
    drawn = mixing.drawn_rows(mixed)
    assert drawn.agg(F.sum("size")).first()[0] == mixed.agg(F.sum("taken")).first()[0]
    assert mixing.mix(frame(spark, []), F.lit(1.0), size).count() == 0


def check_shards(got, shards):
    n = len(got)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r)
    sizes = [len(by_shard.get(s, [])) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by_shard.values())
    whole = Counter(r.source for r in got)
    for own in by_shard.values():
        part = Counter(r.source for r in own)
        assert all(abs(part[s] - whole[s] * len(own) / n) <= 2 for s in whole)


def test_shards_match_the_mixture(spark):
    rows = source_rows({"a": 700, "b": 90, "c": 211, None: 33})
    for shards in (1, 7, 24):
        dealt = sharding.interleave(clashing(frame(spark, rows).repartition(6)), shards)
        check_shards(dealt.collect(), shards)
    again = sharding.interleave(frame(spark, rows).repartition(2), 24).select("doc_id", "shard", "slot")
    assert collected(again) == collected(dealt.select("doc_id", "shard", "slot"))
    other = sharding.interleave(frame(spark, rows), 24, seed=8).select("doc_id", "shard", "slot")
    assert collected(other) != collected(again)


def test_shards_of_odd_rows(spark):
    rows = documents() * 2
    dealt = sharding.interleave(frame(spark, rows), 5, tie="text")
    check_shards(dealt.collect(), 5)
    check_shards(sharding.interleave(frame(spark, rows[:3]), 24).collect(), 24)
    assert sharding.interleave(frame(spark, []), 24).count() == 0


def test_shard_files_hold_the_slots_in_order(spark, tmp_path):
    rows = source_rows({"a": 70, "b": 9})
    dealt = sharding.interleave(frame(spark, rows), 4)
    sharding.write_shards(dealt, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert collected(back.select("shard", "slot", "doc_id")) == collected(dealt.select("shard", "slot", "doc_id"))


def test_size_and_crc(spark):
    size, crc = sharding.checked(frame(spark), "text")
    got = frame(spark).select("doc_id", size, crc)
    want = [(k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, *_ in documents()]
    assert collected(got) == sorted(want, key=repr)


def plain_lines(rows, ratio, least=1):
    trim = " \t\n\v\f\r"
    pages, held = Counter(), Counter()
    for site, text in rows:
        pages[site] += 1
        held.update({(site, x.strip(trim)) for x in (text or "").split("\n") if x.strip(trim)} if text is not None else [])
    gone = {k for k, n in held.items() if n >= least and n > ratio * pages[k[0]]}
    made = []
    for site, text in rows:
        if text is None:
            made.append((site, None, 0, 0))
            continue
        own = text.split("\n")
        kept = [x for x in own if (site, x.strip(trim)) not in gone]
        made.append((site, "\n".join(kept), sum(bool(x.strip(trim)) for x in own), len(own) - len(kept)))
    return sorted(made, key=repr)


def test_line_dedup_against_plain(spark):
    rows = []
    for i in range(200):
        site = ["x.org", "y.org", None][i % 3]
        body = [f"own {i}", "menu " if i % 2 else " menu\t", "", f"seldom {i % 50}", "  "] + ["twice"] * (i % 4)
        rows.append((site, "\n".join(body)))
    rows += [("x.org", None), ("x.org", ""), ("z.org", "menu\nmenu"), ("z.org", "menu"), ("q.org", "\n\n")] * 2
    rows.append(("long.org", "\n".join(f"line {i}" for i in range(20_000))))
    df = clashing(spark.createDataFrame(rows, "source string, text string").repartition(4))
    for ratio, least in ((0.02, 1), (0.3, 1), (0.9, 1), (0.02, 3), (0.3, 50)):
        got = lines.line_dedup(df, F.col("source"), F.col("text"), ratio=ratio, least_pages=least)
        assert collected(got.select("source", "text", "n_lines", "n_dropped")) == plain_lines(rows, ratio, least)


def test_small_sites_follow_the_ratio(spark):
    """A page of its own holds each of its lines; two pages share some."""
    rows = [("one", "a\nb"), ("two", "a\nc"), ("two", "a\nd")]
    df = spark.createDataFrame(rows, "source string, text string")

    def texts(**how):
        return {r.text for r in lines.line_dedup(df, F.col("source"), F.col("text"), **how).collect()}

    assert texts() == {""}
    assert texts(ratio=0.5) == {"", "c", "d"}
    assert texts(least_pages=3) == {"a\nb", "a\nc", "a\nd"}


def test_line_dedup_without_broadcast(spark, monkeypatch):
    rows = [("s", f"own {i}\nshared") for i in range(20)]
    df = spark.createDataFrame(rows, "source string, text string")
    want = collected(lines.line_dedup(df, F.col("source"), F.col("text")))
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    assert collected(lines.line_dedup(df, F.col("source"), F.col("text"))) == want
    assert {r[1] for r in want} == {f"own {i}" for i in range(20)}


def test_line_dedup_empty(spark):
    df = spark.createDataFrame([], "source string, text string")
    assert lines.line_dedup(df, F.col("source"), F.col("text")).count() == 0


def test_page_text_and_host(spark):
    html = "<title>T</title><script>var t='</p>';</script><p class=a>one <b>two</b><br/>three<!-- x\n y --></p>"
    df = spark.createDataFrame([(html, "HTTPS://A.Example.org:80/x"), (None, "nohost")], "html string, url string")
    got = df.select(lines.page_text(F.col("html")), lines.url_host(F.col("url"))).collect()
    assert [x for x in got[0][0].split("\n") if x] == ["T", "one two", "three"]
    assert got[0][1] == "a.example.org" and tuple(got[1]) == (None, None)


def plain_shards(rows, shards):
    """(id, source, tie) and hash of each row, to (id, source, tie, shard, slot)."""
    first = lambda x: (x is not None, x if x is not None else 0)
    groups = {}
    for key, source, tie, hashed in rows:
        label = "" if source is None else f"s{source}"
        groups.setdefault(label, []).append((hashed, first(key), tie, key, source))
    order = []
    for label, own in groups.items():
        own.sort(key=lambda r: r[:3])
        order += [((at + 0.5) / len(own), label, at, r) for at, r in enumerate(own)]
    order.sort(key=lambda r: r[:3])
    n = len(order)
    made = []
    for place, (*_, r) in enumerate(order):
        shard = place * shards // n
        made.append((r[3], r[4], r[2], shard, place - -(-shard * n // shards)))
    return sorted(made, key=repr)


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_interleave_against_plain(spark, shards):
    rows = [(i % 400 if i % 9 else None, "hot" if i % 3 else f"s{i % 7}" if i % 11 else None, i) for i in range(700)]
    df = spark.createDataFrame(rows + rows[:20], "doc_id long, source string, tie long").repartition(5)
    hashed = df.withColumn("h", F.xxhash64(F.lit(7), "doc_id", "source", "tie"))
    want = plain_shards([tuple(r) for r in hashed.collect()], shards)
    got = sharding.interleave(df, shards, tie="tie").select("doc_id", "source", "tie", "shard", "slot")
    assert sorted((r[:2] + r[3:] for r in collected(got)), key=repr) == sorted((r[:2] + r[3:] for r in want), key=repr)
