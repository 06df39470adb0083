"""Whole operators against brute force, hot groups, long texts and joins beyond the broadcast limits."""

import decimal
import glob
import itertools
import math
import os
import random
import struct
import tempfile
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from redlake.llm import chaining, decontaminate, license_scan, line_spread, near_texts, quality_rules, queries, resampling, sharding, simhash, substrings
from redlake.llm.collection_bwt import suffixes_shared
from redlake.llm.common import table, written

from test_dedup import brute_fingerprint, brute_removal, sentence

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def changed_every(rng, passage, n, indel):
    out = []
    for i, w in enumerate(passage):
        if i % n == n // 2 and 0 < i < len(passage) - 1:
            kind = rng.randint(0, 2) if indel else 0
            out += [[words(rng, 1)[0] + "x"], [], [words(rng, 1)[0] + "x", w]][kind]
        else:
            out.append(w)
    return out


# op1, op2, op8: the queries and their SQL.


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, duck, name):
    plain = lambda v: round(float(v), 6) if isinstance(v, float | decimal.Decimal) else v
    df = queries.queries()[name](spark, SF)
    rel = duck.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [list(rel.columns).index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_line_rules(docs):
    body = ". ".join(" ".join(words(random.Random(1), 12)) for _ in range(9)) + "."
    lines = {
        "TOUTE LA LIGNE EST EN CAPITALES ET NE DIT RIEN DU TOUT.": "boilerplate", "Tous droits réservés par la maison.": "boilerplate", "Alle Rechte vorbehalten.": "boilerplate", "volver arriba": "navigation",
        "see http://a.example/b www.c.example now.": "navigation", "-----=====----- end.": "punctuation", f"{body} we set out our privacy policy here": None, "A plain sentence of some words that ends as it should.": None,
    }
    out = {r.doc_id: (r.n_boilerplate, r.n_navigation, r.n_punctuation) for r in quality_rules.clean_lines(docs([(i, f"{body}\n{line}") for i, line in enumerate(lines)])).collect()}
    for i, (line, rule) in enumerate(lines.items()):
        assert out[i] == tuple(int(rule == x) for x in ("boilerplate", "navigation", "punctuation")), line


def test_license_texts(docs):
    plain = [license_scan.re.sub(r"\(([^()|]*)\|?[^()]*\)(\??)", lambda m: "" if m[2] else m[1], text) for _, _, _, text in license_scan.SIGNATURES]
    rows = [*enumerate(plain), (-1, "to accept success, according to account managers")]
    found = {r.doc_id: {d.label for d in r.detections} for r in license_scan.scan_licenses(docs(rows)).collect()}
    for i, (label, _, _, text) in enumerate(license_scan.SIGNATURES):
        assert label in found[i], text
    assert not found[-1]


# op3


def test_rendezvous_by_brute_force(spark):
    weights = {0: 1.0, 1: 2.5, 2: 0.5, 7: 1.0}

    def score(key, shard, weight):
        h = xxhash.xxh64_intdigest(str(key).encode() if key is not None else b"\x00", 42)
        for part in (shard, sharding.SEED):
            h = xxhash.xxh64_intdigest(struct.pack("<i", part), h)
        return -weight / math.log(((h >> 11) + 0.5) / 2**53), shard

    keys = [*range(3000), None]
    got = {r.k: r.shard for r in spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.rendezvous(F.col("k"), weights).alias("shard")).collect()}
    assert got == {k: max(score(k, s, w) for s, w in weights.items())[1] for k in keys}
    share = Counter(got.values())
    assert all(abs(share[s] / 3001 - w / 5) < 0.03 for s, w in weights.items())


def test_sharding_query(spark):
    import zlib

    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    out = sharding.op3_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        text = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "key") and r.grown_shard in (r.shard, 16)
    for shard in range(16):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))


# op4


def test_a_hot_core_is_cut_again(docs):
    rng = random.Random(41)
    line = sentence(rng, 40)[:170]
    texts = [f"{sentence(rng, 25)} {line} {sentence(rng, 25)}" for _ in range(30)] + [f"{sentence(rng, 9)} {a} {line} {b}" for a in ("x" * 40, "y" * 40) for b in ("u" * 40, "v" * 40) for _ in range(2)]
    rows = list(enumerate(texts))
    out = substrings.remove_repeats(docs(rows), large_group=3).collect()
    import hashlib

    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out) == brute_removal(rows)


def test_transforms_in_files():
    rng = np.random.default_rng(1)
    strings = [rng.integers(1, 4, size=n).astype(np.uint16) for n in rng.integers(0, 60, size=40)]
    with tempfile.TemporaryDirectory() as folder:
        in_files = suffixes_shared(strings, 6, folder)
        assert not os.listdir(folder)
    for a, b in zip(in_files, suffixes_shared(strings, 6), strict=True):
        assert a.tolist() == b.tolist()


# op5


def partners(rows):
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, set()).add(r.other_id)
    return found


@pytest.mark.parametrize("slices", [[(0, 35)], [(0, 35), (12, 47), (25, 60)]])
def test_passages_with_decoys(docs, slices):
    """Two texts share a passage; others have parts of it that are too short to count."""
    rng = random.Random(51)
    rows, pairs = [], []
    for i in range(40):
        passage = words(rng, 60)
        parts = [passage, passage, *(passage[a:b] for a, b in slices)]
        rng.shuffle(parts)
        ids = [10 * i + k for k in range(len(parts))]
        rows += [(n, " ".join(words(rng, 40) + p + words(rng, 40))) for n, p in zip(ids, parts, strict=True)]
        pairs.append([n for n, p in zip(ids, parts, strict=True) if p is passage])
    found = partners(chaining.repeated_passages(docs(rows)).collect())
    assert all(b in found.get(a, ()) and a in found.get(b, ()) for a, b in pairs)
    assert set(found) == {n for p in pairs for n in p}


@pytest.mark.parametrize(("every", "indel", "least"), [(8, False, 0.95), (8, True, 0.9), (10, True, 0.9), (14, True, 0.95), (20, True, 0.95)])
def test_recall_of_fuzzy_passages(docs, every, indel, least):
    rng = random.Random(52 + every)
    rows, pairs = [], []
    for i in range(0, 100, 2):
        passage = words(rng, rng.choice([55, 90, 150]))
        other = changed_every(rng, passage, every, indel)
        rows += [(i, " ".join(words(rng, 30) + passage + words(rng, 30))), (i + 1, " ".join(words(rng, 30) + other + words(rng, 30))), (1000 + i, " ".join(words(rng, 30) + passage[10:40] + words(rng, 30)))]
        pairs.append((i, i + 1))
    out = chaining.repeated_passages(docs(rows)).collect()
    found = partners(out)
    assert sum(b in found.get(a, ()) for a, b in pairs) >= least * len(pairs)
    for r in out:  # spans and similarities hold word by word
        a, b = ((dict(rows)[i].split())[s:e] for i, s, e in ((r.doc_id, r.start_word, r.end_word), (r.other_id, r.other_start, r.other_end)))
        same = chaining._common(a, b)
        assert min(len(a), len(b)) >= 50 and r.similarity <= same / max(len(a), len(b)) + 1e-6 and r.similarity >= 0.8


@pytest.mark.parametrize(("every", "indel", "decoys", "n"), [(6, False, 10, 40), (8, True, 10, 30), (10, False, 30, 20)])
def test_recall_among_many_decoys(docs, every, indel, decoys, n):
    """Pairs of edited passages, each among slices of the passage that are too short to count, against an aligner over all pairs that share one."""
    rng = random.Random(60 + every)
    rows, of = [], {}
    for i in range(n):
        passage = words(rng, 56)
        parts = [passage, changed_every(rng, passage, every, indel), *(passage[a : a + 35] for a in (rng.randint(0, 21) for _ in range(decoys)))]
        ids = rng.sample(range(1000 * i, 1000 * i + 999), len(parts))
        for k, p in zip(ids, parts, strict=True):
            rows.append((k, " ".join(words(rng, 40) + p + words(rng, 40))))
            of[k] = p
    similar = lambda a, b: min(len(a), len(b)) >= 50 and chaining._common(a, b) >= 0.8 * max(len(a), len(b))
    want = {(a, b) for i in range(n) for a, b in itertools.permutations([k for k in of if k // 1000 == i], 2) if similar(of[a], of[b])}
    assert len(want) >= n
    found = partners(chaining.repeated_passages(docs(rows)).collect())
    assert sum(b in found.get(a, ()) for a, b in want) >= 0.9 * len(want)


def test_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        table_ = {}
        for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
            table_[i, j] = 0 if not i or not j else table_[i - 1, j - 1] + 1 if a[i - 1] == b[j - 1] else max(table_[i - 1, j], table_[i, j - 1])
        assert chaining._common(a, b) == table_[len(a), len(b)]


def test_repeats_within_a_text(docs):
    rng = random.Random(53)
    passage = " ".join(words(rng, 90))
    rows = [(1, f"{sentence(rng, 40)} {passage} {sentence(rng, 30)} {passage} {sentence(rng, 20)}"), (2, sentence(rng, 200)), (3, (sentence(rng, 12) + " ") * 400), (None, None), (4, "")]
    out = chaining.repeated_passages(docs(rows)).collect()
    assert {(r.doc_id, r.other_id) for r in out} == {(1, 1), (3, 3)}
    assert any(abs(r.start_word - 160) <= 1 and abs(r.other_start - 40) <= 1 for r in out if r.doc_id == 1)
    assert all(r.other_end <= r.start_word for r in out)


# op6


def leaked(spark, texts, items):
    d, b = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {(r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(d, b).where("kind <> 'inconsistent'").collect()}


def test_short_and_numeric_items(spark):
    rng = random.Random(61)
    filler = lambda n: " ".join(words(rng, n))
    items = {1: "What is the capital city of Uruguay?", 2: "Compute 12 + 7 * 3 - 5 / 2 + 9 - 4 = 8", 3: "Tom buys 2 cows and 2 goats at the market and pays 90 dollars for all of them"}
    texts = {n: f"{filler(40)} {t} {filler(40)}" for n, t in items.items()} | {
        4: f"{filler(20)} Ann buys 4 cows and 6 goats at the market and pays 75 dollars for all of them {filler(20)}",
        5: f"{filler(20)} Tom buys 2 cows and 3 goats at the market and pays 90 dollars for all of them {filler(20)}",
        6: f"{filler(20)} compute 13 + 7 * 3 - 5 / 2 + 9 - 4 = 8 {filler(20)}", 7: filler(200),
    }
    got = leaked(spark, texts, items)
    assert {(1, 1, "exact"), (2, 2, "exact"), (3, 3, "exact"), (4, 3, "parameters")} <= got
    assert not {d for d, _, _ in got} & {5, 7}


def test_asked_again_in_four_languages(spark):
    """Names at sentence starts, numbers and units change; at least nine in ten are found."""
    rng = random.Random(62)
    names = ["Boston", "Dover", "Lyon", "Berlin", "Madrid", "Oslo", "Anna", "Peter", "Karl", "Marie"]
    forms = [
        "{a} travels {n} km to the city of {b} and then walks back for {m} hours along the old road before it rains",
        "{a} achète {n} pommes et {m} poires au marché de {b} puis rentre chez sa mère avec tout le panier",
        "{a} fährt {n} km nach {b} und läuft dann noch {m} Stunden durch den Wald bis es dunkel wird",
        "{a} compra {n} libros en la tienda de {b} y los lee durante {m} horas antes de volver a su casa",
    ]
    items, texts = {}, {}
    for i in range(80):
        form = forms[i % 4] + " " + " ".join(words(rng, 6))
        fill = lambda: form.format(a=rng.choice(names), b=rng.choice(names), n=rng.randint(2, 99), m=rng.randint(100, 999))  # noqa: E731, B023
        items[i], texts[i] = fill(), f"{' '.join(words(rng, 30))}. {fill()}. {' '.join(words(rng, 30))}"
    got = leaked(spark, texts, items)
    assert sum((i, i) in {(d, n) for d, n, _ in got} for i in items) >= 0.9 * len(items)


# op7


def test_ratios_by_brute_force(spark):
    rng = random.Random(71)
    rows = [(i, " ".join(words(rng, 30)) + rng.choice(["", " !!! ###", " (a-b) C3PO"])) for i in range(60)]
    labels = [(i, i % 3 > 0, 0) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = resampling.fit(d, spark.createDataFrame([(i, int(q), t) for i, q, t in labels], "doc_id long, quality int, toxic int"), buckets=512)
    raw, target = Counter(), Counter()
    for i, t in rows:
        ws, found = t.split(), []
        for w in ws:
            m = resampling._INNER.search(w)
            core, marks = (m[0], w[: m.start()] + w[m.end() :]) if m else ("", w)
            core = "".join("0" if c.isdigit() else c for c in core)
            case = "^" if len(core) > 1 and core.isupper() else ""
            crc = lambda s: resampling.zlib.crc32(s.encode())
            found.append((crc(core.lower()), crc(marks + case) if marks or case else 0))
        mask, p, q = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
        for (a, mark), (b, _) in itertools.zip_longest(found, found[1:], fillvalue=(None, 0)):
            grams = [a] + ([(mark * 0x165667B19E3779F9 & mask) >> 17] if mark else [])
            if b is not None:
                x = p if a == b else (a * p & mask) ^ (b * q & mask)
                grams.append(x ^ x >> 29)
            for g in grams:
                raw[g % 512] += 1
                target[g % 512] += i < 40 and i % 3 > 0
    share = sum(target.values()) / sum(raw.values())
    want = [math.log((target[b] + resampling.SMOOTHING) / (raw[b] * share + resampling.SMOOTHING)) for b in range(512)]
    assert np.allclose(model.ratios, want)


def test_draws_by_importance(spark):
    """Inclusion frequencies over seeds are those of Gumbel top-k; a draw is what the noise says."""
    weights, k, seeds = [0.0, 0.5, 1.0, 2.0, -1.0, -3.0], 3, 4000
    noise = spark.range(len(weights)).crossJoin(spark.range(seeds).toDF("seed"))
    # The seed stands where weigh() has a literal; the key is the row's.
    rows = noise.select("id", "seed", *[resampling.gumbel(F.struct("id", "seed")).alias("g")]).collect()
    g = np.zeros((seeds, len(weights)))
    for r in rows:
        g[r.seed, r.id] = r.g
    assert abs(g.mean() - 0.5772) < 0.05 and abs(g.std() - math.pi / 6**0.5) < 0.05
    count = lambda s: np.bincount(np.argsort(-s, axis=1)[:, :k].ravel(), minlength=len(weights)) / seeds
    brute = np.random.default_rng(1).gumbel(size=(seeds, len(weights)))
    assert np.allclose(count(g + weights), count(brute + weights), atol=0.04)
    d = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "row long, w double")
    for seed in range(3):
        s = d.withColumn("s", F.col("w") + resampling.gumbel(F.col("row"), seed)).coalesce(1).cache()
        got = {r.row for r in s.where(resampling.top_k(s, ["s", "row"], k)).collect()}
        assert got == {r.row for r in sorted(s.collect(), key=lambda r: -r.s)[:k]}


@pytest.fixture(scope="module")
def weighed(spark):
    """The rows of the small tables with the weights that the whole operator gives them."""
    d, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = resampling.weigh(d.select("doc_id", "text"), resampling.fit(d, labels)).drop("text")
    return written(rows, "weighed"), labels


def test_the_noise_decides(spark, weighed):
    """Over seeds and real weights: what is kept isn't the k highest weights, and rows are kept as often as by numpy's noise."""
    rows, labels = weighed
    k = resampling.target_mass(rows, labels)
    local = rows.where(resampling._DRAWN).select("doc_id", "__log_weight").toPandas()
    w = local["__log_weight"].to_numpy()
    assert 0 < k < len(w)
    noiseless = set(local.doc_id[np.argsort(-w, kind="stable")[:k]])
    times, seeds = Counter(), range(40)
    for seed in seeds:
        summed = written(rows.withColumn("s", F.col("__log_weight") + resampling.gumbel(F.col("doc_id"), seed)).coalesce(1), "sums")
        kept = {r.doc_id for r in summed.where(resampling.top_k(summed, ["s", "__row"], k, resampling._DRAWN)).collect()}
        assert len(kept) == k and kept != noiseless
        times.update(kept)
    rng, brute = np.random.default_rng(1), np.zeros(len(w))
    for _ in range(4000):
        brute[np.argpartition(-(w + rng.gumbel(size=len(w))), k - 1)[:k]] += 1
    brute, got = brute / 4000, np.array([times[i] for i in local.doc_id]) / len(seeds)
    near = (brute > 0.02) & (brute < 0.98)
    assert near.sum() > 20, "the draw is graded"
    assert abs(got - brute).mean() < 0.03 and abs(got[near].mean() - brute[near].mean()) < 0.05
    assert k / 3 < resampling.effective_size(rows) <= len(w)


def test_words_of_rejects_are_barred(spark):
    rng = random.Random(72)
    rows = [(i, " ".join([*words(rng, 60), *(["Grob,", "fies!"] if i % 4 == 0 else [])])) for i in range(400)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)]
    out = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r.doc_id for r in out if r["__n_barred"]} == {i for i in range(400) if i % 4 == 0}
    assert np.mean([r["__kept"] for r in out if r.doc_id % 4 == 0]) < 0.1 and np.mean([r["__kept"] for r in out if r.doc_id % 4]) > 0.9


# op9


def test_simhash_query(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    out = {r.doc_id: r for r in simhash.op9_simhash(spark, SF).collect()}
    assert {i: f"{brute_fingerprint(t):016x}" for i, t in texts.items()} == {i: r.fingerprint for i, r in out.items()}


def test_wide_radius():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, size=4, dtype=np.uint64)
    fps = np.array([base[i % 4] ^ sum((np.uint64(1) << np.uint64(b) for b in rng.choice(64, size=i % 24, replace=False)), np.uint64(0)) for i in range(300)], dtype=np.uint64)
    for radius in (5, 21):
        i, j = simhash.sliced_links(fps, radius)
        want = {(a, b) for a in range(300) for b in range(a + 1, 300) if int(fps[a] ^ fps[b]).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


# Joins beyond the broadcast limits, and very long texts.


def test_merge_joins_give_the_same(spark, docs, monkeypatch):
    rng = random.Random(81)
    passage, footer = " ".join(words(rng, 60)), [" ".join(words(rng, 5)) for _ in range(3)]
    rows = [(i, "\n".join([" ".join(words(rng, 40)), *footer, f"{' '.join(words(rng, 20))} {passage if i % 3 == 0 else ''} {' '.join(words(rng, 30))}"])) for i in range(36)]
    d = docs(rows).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 12))
    b = spark.createDataFrame([(1, passage), (2, "nothing of it is in here at all my friend")], "item_id long, text string")

    def run():
        return [
            Counter(map(tuple, substrings.remove_repeats(d).collect())), Counter(map(tuple, chaining.repeated_passages(d).collect())), Counter(map(tuple, decontaminate.leaks(d, b).collect())),
            Counter((r.doc_id, r["__clean"]) for r in line_spread.remove_boilerplate(d).collect()), Counter(map(tuple, near_texts.near_duplicates(d).collect())),
        ]

    usual = run()
    assert all(usual) and any(r[2] for r in usual[0]) and len(usual[2]) == 12 and not any(footer[0] in t for _, t in usual[3])
    for module, name in ((substrings, "BROADCAST_CORES"), (chaining, "BROADCAST_TEXTS"), (decontaminate, "BROADCAST_WINDOWS"), (line_spread, "BROADCAST_LINES"), (near_texts, "BROADCAST_TEXTS")):
        monkeypatch.setattr(module, name, 0)
    assert run() == usual


def test_very_long_texts(spark):
    rng = random.Random(82)
    long = " ".join(words(rng, 60_000)) + " MIT License" * 2000 + "\n" + "\n".join(" ".join(words(rng, 6)) for _ in range(2000))
    rows = [(1, long, "en", "s1", len(long)), (2, long.replace("MIT", "the MIT", 1), "en", "s2", len(long) + 4), (3, "short text", "en", "s3", 10), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    licenses = {r.doc_id: r for r in license_scan.scan_licenses(d).collect()}
    assert sum(p.base for p in licenses[1].places) == 2000 and not licenses[3].places
    item = " ".join(long.split()[30_000:30_030])
    assert leaked(spark, {1: long}, {5: item}) == {(1, 5, "exact")}
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    weighed = {r.doc_id: r for r in resampling.resample(d, labels).collect()}
    assert weighed[1]["__n_features"] > 120_000 and len(weighed) == 4
    assert {r.doc_id: r["__n_lines"] for r in line_spread.remove_boilerplate(d).collect()} == {1: 2001, 2: 2001, 3: 1, None: 0}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, d, SF).collect()} == {1, 3, None}
    (r,) = [r for r in chaining.repeated_passages(d).collect() if r.doc_id == 2 and r.other_id == 1 and r.start_word == 0]
    assert r.end_word > 60_000
