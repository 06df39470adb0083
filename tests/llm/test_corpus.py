"""Line spread, decontamination, resampling, BPE and the pipeline."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from redlake.llm import byte_bpe, decontaminate, line_spread, resampling
from redlake.llm.common import table

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_line_spread(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        lines = [words(rng, 6) for _ in range(4)]
        if i < 30:
            lines.insert(rng.randint(0, 4), "seen on ten sites or more")  # sites 0 to 14
        if i < 18:
            lines.insert(rng.randint(0, 4), " seen on nine sites  " if i % 9 else "seen on nine sites")
        if i < 20:
            lines.insert(0, "seen on ten sites exactly")
        rows.append((i, "\n".join(lines), f"s{i % (9 if i < 18 else 15)}" if i < 18 else f"s{i % 15}"))
    rows = [(i, t, f"s{i % 9}" if "nine" in t and "exactly" not in t else s) for i, t, s in rows]
    copy = "\n".join(words(rng, 5) for _ in range(5))
    rows += [(100 + i, copy, f"s{i % 15}") for i in range(40)] + [(None, None, None), (1, "", "s1"), (2, "\n \n", None)]
    footer = [words(rng, 5) for _ in range(4)]
    rows += [(200 + i, "\n".join([words(rng, 30), words(rng, 30), *footer]), f"s{i % 15}") for i in range(30)]
    base = [words(rng, 9) for _ in range(9)]  # near copies, each with a line of its own
    rows += [(300 + i, "\n".join([*base[: i % 9], words(rng, 9), *base[i % 9 + 1 :]]), f"s{i % 15}") for i in range(30)]

    thin = [words(rng, 7) for _ in range(4)]  # a footer under one short line, on pages that have nothing else
    rows += [(400 + i, "\n".join([words(rng, 4), *thin]), f"thin{i}") for i in range(60)]

    def lines_of(t):
        return [x for x in (y.strip(" \t\n\x0b\x0c\r") for y in (t or "").split("\n")) if x]

    spread, hosted, sites = defaultdict(set), defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        sites[t].add(s or "")
        for x in lines_of(t):
            spread[x].add(s)
    for t, found in sites.items():
        wide = [x for x in lines_of(t) if len(spread[x]) >= 10]
        if 3 * sum(map(len, wide)) < 2 * sum(map(len, lines_of(t))) or sum(map(len, wide)) < 400:
            for x in wide:
                hosted[x].add(min(found))
    bad = {x for x in hosted if len(hosted[x]) >= 10}
    assert set(footer) | set(thin) <= bad and not bad & set(base)
    assert "seen on ten sites or more" in bad and not any(x in bad for x in copy.split("\n"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as h", "2 as key")
    out = line_spread.remove_boilerplate(df).collect()
    want = Counter((i, s, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r") not in bad)) for i, t, s in rows)
    assert Counter((r.doc_id, r.source, r["__clean"]) for r in out) == want
    assert line_spread.remove_boilerplate(df.limit(0)).count() == 0


QUESTION = "A train leaves Boston at 9 and travels 120 km to the city of Springfield before it turns around and travels the same 120 km back again to the station"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (QUESTION, "exact"),
        (QUESTION.replace("120", "75").replace("Boston", "Dover"), "parameters"),
        (QUESTION.replace("120", "75", 1), None),
        ("nothing of the kind here in this text of some words that goes on for a while", None),
        ("", None),
        (None, None),
    ],
)
def test_decontamination(spark, text, kind):
    rng = random.Random(2)
    long = None if text is None else f"{words(rng, 40)}. {text} {words(rng, 30)}"
    d = spark.createDataFrame([(1, long), (1, long), (2, words(rng, 100))], "doc_id long, text string").selectExpr("*", "1 as h", "'x' as slots", "2 as item_id")
    b = spark.createDataFrame([(7, QUESTION), (8, "too short"), (9, None), (10, "")], "item_id long, text string")
    out = decontaminate.leaks(d, b).where("kind <> 'inconsistent'").collect()
    assert [(r.doc_id, r.item_id, r.kind) for r in out] == ([(1, 7, kind)] * 2 if kind else [])
    assert decontaminate.clean_documents(d, b).count() == (1 if kind else 3)
    assert decontaminate.leaks(d.limit(0), b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


def test_planted_items_are_found(spark):
    d, b = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    items = b.collect()
    want = {(r.doc_id, i.item_id) for r in d.collect() for i in items if i.text in r.text}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).where("kind <> 'inconsistent'").collect()}
    assert want and want <= got and len(got - want) <= len(want) * 0.1


@pytest.mark.parametrize("k", [0, 1, 5, 100, 9999, 10000, 20000])
def test_top_k(spark, k, monkeypatch):
    monkeypatch.setattr(resampling, "BINS", 16)
    rng = random.Random(3)
    values = [rng.choice([1.0, 2.0, rng.gauss(0, 50), rng.random()]) for _ in range(10_000)]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "s double, row long").coalesce(2).cache()
    got = {r.row for r in rows.where(resampling.top_k(rows, ["s", "row"], k)).collect()}
    assert got == {i for _, i in sorted(((v, i) for i, v in enumerate(values)), reverse=True)[:k]}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    half = labels.where("doc_id % 2 = 0")
    kept = {r.doc_id: r["__kept"] for r in resampling.resample(d, half).select("doc_id", "__kept").collect()}
    held = [(r.quality, r.toxic, kept[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect()]
    good, bad = [k for q, t, k in held if q == 1 and t == 0], [k for q, _, k in held if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_resampling_edges(spark):
    d = spark.createDataFrame([(None, None), (1, ""), (2, "good words here"), (2, "good words here"), (3, "### $$$ !!")], "doc_id long, text string").selectExpr("*", "1 as bucket", "true as target")
    labels = spark.createDataFrame([(2, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    out = resampling.resample(d, labels)
    assert out.count() == 5 and {"bucket", "target"} <= set(out.columns)
    assert all(r["__log_weight"] == 0 for r in out.where("text is null or text = ''").collect())
    assert resampling.resample(d, labels, 2).where("__kept").count() == 2
    assert resampling.resample(d, labels.limit(0)).where("__kept").count() == 5
    assert resampling.resample(d.limit(0), labels).count() == 0


@pytest.fixture(scope="module")
def reference_encoding():
    with open(byte_bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoding(reference_encoding, text):
    e = byte_bpe.encoder()
    ids = e.encode(text)
    assert np.frombuffer(ids, dtype="<u4").tolist() == reference_encoding.encode_ordinary(text)
    assert e.decode(ids) == text.encode()


def test_encoding_of_texts(docs, reference_encoding):
    rng = random.Random(9)
    texts = [None, "", " ", "\n\n  \n", "hello  world's 123", "é" * 3000, "a" * 5000, "!" * 4001, "x" + " " * 3000 + "y", words(rng, 2000), "<|endoftext|>", "🙂👍🏽 é"]
    out = byte_bpe.encode_texts(docs([(i, t) for i, t in enumerate(texts)] + [(None, "n"), (3, "\n\n  \n")])).collect()
    for r in out:
        text = "n" if r.doc_id is None else texts[r.doc_id] or ""
        ids = reference_encoding.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encode_texts(docs([])).count() == 0


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    n = table(spark, SF, "documents").count()
    assert 0 < out.count() < n
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


def test_pipeline_stages_take_odd_rows(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (5, "a b c", None, None, 5)], docs.schema)
    for d in (docs.limit(20).union(odd), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= d.count()
        assert corpus_pipeline.STAGES[-1][1](spark, d, SF).count() == d.count()


def test_stages_keep_clean_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert corpus_pipeline.lines(spark, docs, "/root/testdata/sf0.01").count() == docs.count()
    one = corpus_pipeline.near_duplicates(spark, docs, "/root/testdata/sf0.01")
    assert one.select("text").distinct().count() == one.count()
