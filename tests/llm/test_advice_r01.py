"""Whole results where a review found parts missing."""

import itertools
import random

import pytest

import corpus_pipeline
from redlake.llm import chaining, decontaminate, near_texts, resampling
from redlake.llm.common import written

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def changed(rng, text, places):
    text = list(text)
    for p in places:
        text[p] = words(rng, 1)[0] + "x"
    return text


def test_pipeline_drops_near_copies(spark):
    """Groups are those of brute force over all pairs, at similarities around 0.8 and above."""
    rng = random.Random(31)
    texts = []
    for i in range(60):
        base = words(rng, rng.choice([30, 100, 300]))
        texts.append(base)
        for _ in range(2):
            texts.append(changed(rng, base, rng.sample(range(len(base)), rng.randint(1, max(1, len(base) // 40)))))
    texts = [" ".join(t) for t in texts] + ["", "a b", "a  B"]
    found = [near_texts.shingles(near_texts.words_of(t)) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if near_texts.jaccard(found[i], found[j]) >= 0.8]
    root = list(range(len(texts)))
    for i, j in links * 3:
        root[i] = root[j] = min(root[i], root[j])
    assert len(links) > 50
    docs = written(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS), "test")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, r in enumerate(root) if r == i}


def test_passages_with_a_change_every_few_words_are_found(docs):
    rng = random.Random(32)
    rows = []
    for i, every in enumerate((5, 6, 8, 10) * 5):
        passage = words(rng, 50)
        other = changed(rng, passage, range(every // 2, 50, every))
        rows += [(2 * i, " ".join(words(rng, 40) + passage + words(rng, 40))), (2 * i + 1, " ".join(words(rng, 40) + other + words(rng, 40)))]
    found = {(r.doc_id, r.other_id) for r in chaining.repeated_passages(docs(rows)).collect()}
    assert {(i, i ^ 1) for i, _ in rows} <= found


def test_passages_whose_parts_stand_elsewhere_are_found(docs):
    """Whatever the order of the texts' hashes: each of many such groups of four."""
    rng = random.Random(33)
    rows, want = [], set()
    for i in range(0, 80, 4):
        passage = words(rng, 60)
        middle = [passage[:30], passage, passage, passage[30:]]
        rows += [(i + k, " ".join(words(rng, 40) + m + words(rng, 40))) for k, m in enumerate(middle)]
        want |= {(i + 1, i + 2), (i + 2, i + 1)}
    found = {(r.doc_id, r.other_id) for r in chaining.repeated_passages(docs(rows)).collect()}
    assert found == want


def test_long_extension_is_not_cut(docs, monkeypatch):
    monkeypatch.setattr(chaining, "MARGIN", 3)
    rng = random.Random(34)
    a = words(rng, 300)
    cut = (True, True)
    assert chaining.align(a, a, [150], [150]) == (0, 300, 0, 300, 300)
    with pytest.raises(chaining._Cut):
        chaining.align(a[100:200], a, [50], [150], cut)


def test_pipeline_removes_whole_blocks(spark):
    rng = random.Random(35)
    block, copy = [" ".join(words(rng, 5)) for _ in range(5)], [" ".join(words(rng, 6)) for _ in range(4)]
    rows = [(i, "\n".join([" ".join(words(rng, 8)), *block, " ".join(words(rng, 8))]), "en", f"s{i % 12}", 0) for i in range(24)]
    rows += [(100 + i, "\n".join(copy), "en", f"s{i % 12}", 0) for i in range(24)]
    out = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.lines(spark, spark.createDataFrame(rows, COLUMNS), "").collect()}
    assert all(len(out[i]) == 2 and not set(out[i]) & set(block) for i in range(24))
    assert all(out[100 + i] == copy for i in range(24))


QUESTION = "A train leaves Boston at 9 and travels 120 km to the city of Springfield before it turns around and travels the same 120 km back again to the station"


def test_versions_of_an_item_do_not_hide_each_other(spark):
    rng = random.Random(36)
    filler = lambda n: " ".join(words(rng, n))
    changed_one = QUESTION.replace("120", "75")
    mixed = QUESTION.replace("120", "75", 1)
    short = "why do green herons sleep"
    texts = {
        1: f"{filler(40)} {QUESTION} {filler(40)} {changed_one} {filler(9)}", 2: f"{changed_one} {QUESTION.replace('120', '60')}",
        3: f"{filler(9)} {mixed} {filler(9)}", 4: f"{filler(30)} {short} {filler(30)}", 5: filler(90),
    }
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    b = spark.createDataFrame([(7, QUESTION), (8, short), (9, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(d, b).where("kind <> 'inconsistent'").collect()}
    assert got == {(1, 7, "exact"), (2, 7, "parameters"), (4, 8, "exact")}
    assert {r.doc_id for r in decontaminate.clean_documents(d, b).collect()} == {3, 5}


def test_toxic_rows_are_no_target(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, None), (5, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in resampling.target_ids(labels).collect()} == {1, 4}
