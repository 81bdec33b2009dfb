import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from cases import clashing, collected, documents, frame, words

from culprit.llm import piece_codec as codec
from culprit.llm import quality as quality
from culprit.llm import secret_scan
from culprit.llm import token_counts as tokens
from culprit.llm.secret_scan import BASE_RULES, LEDGER, RULES, scan_secrets, span_text

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def plain_tokens(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    return sorted(
        (
            (k, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids))
            for k, t, *_ in rows
        ),
        key=repr,
    )


@pytest.mark.parametrize("block", [1, 500, 10**8])
def test_token_counts_against_the_library(spark, block):
    df = clashing(frame(spark).repartition(3))
    assert collected(tokens.token_counts(df, BYTES, block_chars=block)) == plain_tokens(documents())


def test_token_counts_over_whole_table(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert collected(tokens.token_counts(df, BYTES)) == plain_tokens(rows)


def test_token_counts_empty(spark):
    assert collected(tokens.token_counts(frame(spark, []), BYTES)) == []


def test_token_counts_refuses_other_kinds(spark):
    with pytest.raises(ValueError):
        tokens.token_counts(frame(spark), public_tokenizers.path("word_bpe_49k.json"))


def test_agreed_characters_are_cut_alike():
    import regex

    cut = tokens.load(BYTES).pre_tokenizer.pre_tokenize_str
    agreed, split = regex.compile(tokens.AGREED), regex.compile(tokens.SPLIT)
    checked = 0
    for code in (*range(0xD800), *range(0xE000, 0x10000), *range(0x1F000, 0x2A6E0)):
        c = chr(code)
        if not agreed.fullmatch(c):
            continue
        text = f"a{c}a 1{c}1 !{c}! {c}"
        assert [text[x:y] for _, (x, y) in cut(text)] == split.findall(text), hex(code)
        checked += 1
    assert checked > 90_000


def test_planes_round_trip():
    for values in ([], [0], [1, 255, 256, 70_000, 2**31]):
        assert tokens.unplanes(tokens.planes(np.array(values, np.int64))).tolist() == values


def plain_pieces(rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    made = []
    for key, text, *_ in rows:
        ids = model.encode(text or "")
        made.append((key, ids, model.decode(ids)))
    return sorted(made, key=repr)


def test_pieces_against_the_library(spark):
    got = codec.encode_pieces(clashing(frame(spark)), PIECES)
    assert collected(got.select("doc_id", "ids", "decoded")) == plain_pieces(documents())


def test_pieces_cover_the_text_in_order(spark):
    for row in codec.encode_pieces(frame(spark), PIECES).collect():
        own = next(t for k, t, *_ in documents() if k == row.doc_id and (t or "") == row.decoded)
        raw = (own or "").encode()
        assert row.starts[1:] == row.ends[:-1]
        assert b"".join(raw[a:b] for a, b in zip(row.starts, row.ends)) == raw


def test_pieces_empty(spark):
    assert collected(codec.encode_pieces(frame(spark, []), PIECES)) == []


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normaliser_against_the_library(rule, squeeze):
    import sentencepiece

    library = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze
    )
    use = codec.settings(library.serialized_model_proto())
    draw = random.Random(3)
    pool = "aB ﬁ①Ａ　ｶﾞéÅ½㌔  \t\nßİ"
    for _ in range(1500):
        text = "".join(
            draw.choice(pool) if draw.random() < 0.8 else chr(draw.randrange(1, 0xD7FF))
            for _ in range(draw.randrange(0, 14))
        )
        normal, origin = codec.normalise(text.encode(), use)
        assert normal.decode() == library.normalize(text)
        assert len(origin) == len(normal) + 1
        assert (np.diff(origin) >= 0).all() and origin[-1] <= len(text.encode())


def test_normaliser_says_where_bytes_came_from():
    import sentencepiece

    library = sentencepiece.SentencePieceNormalizer(
        rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False
    )
    use = codec.settings(library.serialized_model_proto())
    normal, origin = codec.normalise("a㌔b".encode(), use)
    assert normal.decode() == "aキロb"
    assert origin.tolist() == [0] + [1] * 6 + [4, 5]


PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": (2, 6), "access": (0, 20), "hex": (0, 24)}


def plain_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        group, least = LEAST[kind]
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[group]) >= least:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(found))


def secret_rows():
    draw = random.Random(11)
    bits = ["password", "Secret", "TOKEN", "apikey", "api_KEY", "=", ":", " ", '"', "'", "ab", "token", "x9+/_", "é", "\n"]
    bits += ["AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "😀", "deadbeef", "-"]
    rows = documents()
    for i in range(400):
        rows.append((100 + i, "".join(draw.choice(bits) for _ in range(draw.randrange(2, 40))), "en", "s", 0))
    return rows


def test_secrets_against_plain(spark):
    found, _ = scan_secrets(clashing(frame(spark, secret_rows())))
    kinds = {r.kind for r in BASE_RULES}
    got = sorted(
        ((r.doc_id, ",".join(s for s in r.spans.split(",") if s.split(":")[0] in kinds)) for r in
         found.select("doc_id", span_text(found["findings"]).alias("spans")).collect()),
        key=repr,
    )
    assert got == sorted(((k, plain_spans(t)) for k, t, *_ in secret_rows()), key=repr)


def test_secrets_added_kinds(spark):
    text = "a -----BEGIN RSA PRIVATE KEY----- b ghp_" + "a1B2" * 9
    found, _ = scan_secrets(frame(spark, [(1, text, None, None, 0)]))
    assert found.select(span_text(found["findings"])).first()[0] == "pem:2:33,forge:36:76"


def test_ledger_scans_only_what_is_unseen(spark):
    rows = secret_rows()
    found, ledger = scan_secrets(frame(spark, rows))
    whole = collected(found)
    ledger = ledger.cache()
    blobs = len({t or "" for _, t, *_ in rows})
    assert ledger.count() == blobs * len(RULES)
    assert ledger.schema.simpleString() == spark.createDataFrame([], LEDGER).schema.simpleString()
    again, more = scan_secrets(frame(spark, rows), ledger=ledger)
    assert collected(again) == whole and more.count() == 0
    half = ledger.where("rule <> 'hex@1'")
    again, more = scan_secrets(frame(spark, [*rows, (999, "new token=abcdef1", "en", "s", 0)]), ledger=half)
    assert [r for r in collected(again) if r[0] != 999] == whole
    assert more.count() == blobs + len(RULES)
    assert {r.rule for r in more.where("rule <> 'hex@1'").select("rule").distinct().collect()} == {
        r.key for r in RULES if r.key != "hex@1"
    }


def test_secrets_empty(spark):
    found, ledger = scan_secrets(frame(spark, []))
    assert collected(found) == [] and collected(ledger) == []


def plain_counts(text):
    text = text or ""
    own = words(text)
    triples = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    hit = {i + d for i, t in enumerate(triples) if triples.count(t) > 1 for d in range(3)} if len(own) < 5000 else None
    if hit is None:
        count = {}
        for t in triples:
            count[t] = count.get(t, 0) + 1
        hit = {i + d for i, t in enumerate(triples) if count[t] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (
        len(own),
        sum(map(len, own)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(hit),
    )


def test_quality_counts_against_plain(spark):
    model = quality.fit_trees(np.zeros((0, len(quality.FEATURES))), np.zeros(0), np.zeros(len(quality.FEATURES)))
    got = quality.quality_rules(clashing(frame(spark)), model)
    want = []
    for key, text, *_ in documents():
        counts = plain_counts(text)
        want.append((key, *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0]))
    assert collected(got.select("doc_id", *quality.COUNTS, "base_failed")) == sorted(want, key=repr)
    assert got.where("kept = base_failed").count() == 0


def test_quality_held_out(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit_quality(docs, labels.where("doc_id % 2 = 0"))
    told = quality.quality_rules(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    right = (told.score >= 0.5) == (told.quality == 1)
    assert right.mean() > 0.95


def test_trees_are_monotone_where_asked():
    draw = np.random.RandomState(2)
    x = draw.rand(3000, 3)
    y = (np.sin(6 * x[:, 0]) + x[:, 1] + draw.randn(3000) * 0.3 > 0.8).astype(float)
    free = quality.fit_trees(x, y, np.array([0, 0, 0]))
    bound = quality.fit_trees(x, y, np.array([-1, 1, 0]))
    grid = np.linspace(0, 1, 101)
    falls = 0
    for _ in range(50):
        at = np.tile(draw.rand(3), (101, 1))
        at[:, 0] = grid
        assert (np.diff(bound.score(at)) <= 1e-12).all()
        falls += (np.diff(free.score(at)) > 1e-9).any()
        at = np.tile(draw.rand(3), (101, 1))
        at[:, 1] = grid
        assert (np.diff(bound.score(at)) >= -1e-12).all()
    assert falls and ((free.score(x) > 0.5) == y).mean() > 0.85


def test_flat_trees_score_as_walked(spark):
    draw = np.random.RandomState(4)
    x = draw.rand(800, 4)
    y = (x[:, 0] > x[:, 2]).astype(float)
    model = quality.fit_trees(x, y, np.zeros(4), trees=9)

    def walk(row):
        total = model.start
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - (2**model.depth - 1)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x), [walk(r) for r in x])


def test_quality_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(frame(spark), labels)
    rows = [*documents(), (77, " ".join(f"word{i}" for i in range(70)), "en", "s", 0)]
    got = quality.quality_rules(frame(spark, rows), model).where("kept")
    assert {r.doc_id for r in got.collect()} == {77}
    assert collected(quality.quality_rules(frame(spark, []), model)) == []


def test_patterns_take_time_in_proportion(spark):
    """Several MB of what could make a pattern start over and over."""
    size = 5_000_000
    hard = ["eyJ", "eyJaaaaaaaa.", "AKIA", "0123456789abcdef0123456 ", "ghp_", "token ", "-----BEGIN A", "secret" + " " * 99]
    rows = [(i, (unit * (size // len(unit)))[:size], "en", "a", size) for i, unit in enumerate(hard)]
    began = time.time()
    found, _ = scan_secrets(frame(spark, rows).repartition(8))
    assert found.count() == len(hard)
    assert time.time() - began < 120


def test_spans_of_unknown_runs():
    """A model without byte pieces merges unknown characters that stand side by side."""

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    def field(number, kind, body):
        return varint(number << 3 | kind) + (varint(len(body)) + body if kind == 2 else body)

    pieces = [("<unk>", 2), ("<s>", 3), ("</s>", 3), ("▁", 1), ("a", 1), ("b", 1), ("ab", 1), ("c", 1)]
    proto = b"".join(
        field(1, 2, field(1, 2, text.encode()) + field(2, 5, np.float32(-i).tobytes()) + field(3, 0, varint(kind)))
        for i, (text, kind) in enumerate(pieces)
    )
    # Unigram without a character map: spaces are escaped and led by one, nothing else.
    proto += field(2, 2, field(3, 0, b"\x01") + field(4, 0, varint(len(pieces))))
    proto += field(3, 2, field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01"))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=proto)
    use, widths = codec.settings(model.serialized_model_proto()), codec.piece_widths(model)
    for text in ("xyz", "abxyzab", "é", "aéxb xx", "", "日本ab語語語"):
        ids = np.array(model.encode(text), np.int64)
        normal, origin = codec.normalise(text.encode(), use)
        start, end = codec.spans(codec.own_widths(model, text, ids, widths), normal, origin)
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(start, end, strict=True)) == raw
        for i, a, b in zip(ids, start, end, strict=True):
            piece = model.id_to_piece(int(i))
            if piece in ("a", "b", "c", "ab"):
                assert raw[a:b].decode() == piece


def test_quality_sample_holds_one_row_a_key(spark, monkeypatch):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, f"text {i} " * 60, "en", "a", 0) for i in range(500)] + [(2, "other " * 80, "en", "a", 0)]
    seen = []
    monkeypatch.setattr(quality, "fit_trees", lambda x, y, d: seen.append(len(y)))
    quality.fit_quality(frame(spark, rows), labels, sample_rows=10)
    assert seen == [2]


def test_arrivals_scan_only_unseen_pairs(spark, tmp_path, monkeypatch):
    rows = secret_rows()
    half = len(rows) // 2
    arrivals = [frame(spark, rows[:half]), frame(spark, rows[: half + 3]), frame(spark, rows)]
    scanned = []
    plain_scan = secret_scan.scan

    def counted(blobs, rules):
        scanned.append({(bytes(r.blob), rule) for r in blobs.collect() for rule in r.todo})
        return plain_scan(blobs, rules)

    monkeypatch.setattr(secret_scan, "scan", counted)
    ledger = secret_scan.scan_arrivals(arrivals, str(tmp_path / "ledger"))
    blobs = [{t or "" for _, t, *_ in r} for r in (rows[:half], rows[: half + 3], rows)]
    new = [len(blobs[0]), len(blobs[1] - blobs[0]), len(blobs[2] - blobs[1])]
    assert [len(s) for s in scanned] == [n * len(RULES) for n in new]
    assert not scanned[0] & scanned[1] and not (scanned[0] | scanned[1]) & scanned[2]
    # A new version of one rule is due on every blob, and nothing else is.
    newer = [r._replace(version=r.version + 1) if r.kind == "hex" else r for r in RULES]
    assert secret_scan.scan_unseen(frame(spark, rows), ledger=ledger, rules=newer).count() == len(blobs[2])
    whole, _ = scan_secrets(frame(spark, rows))
    told = secret_scan.path_findings(frame(spark, rows), ledger)
    assert collected(told) == collected(whole)
