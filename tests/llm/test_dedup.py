"""SimHash, components, byte-string removal and fuzzy passages against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from redlake.llm import chaining, simhash, substrings
from redlake.llm.collection_bwt import suffixes_shared
from redlake.llm.components import components


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(n))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(1)
    for t in [None, "", " \n", "one", "One TWO", "é É a b c", sentence(rng, 300), "w " * 5000]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("m", [2, 63, 64, 65, 300])
def test_sliced_links(m):
    rng = np.random.default_rng(m)
    base = rng.integers(0, 2**63, size=5, dtype=np.uint64)
    fps = np.array([base[i % 5] ^ sum((np.uint64(1) << np.uint64(b) for b in rng.choice(64, size=i % 5, replace=False)), np.uint64(0)) for i in range(m)], dtype=np.uint64)
    i, j = simhash.sliced_links(fps)
    want = {(a, b) for a in range(m) for b in range(a + 1, m) if int(fps[a] ^ fps[b]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


@pytest.mark.parametrize("square", [3, 1000])
def test_all_links_are_found(spark, square):
    rng = np.random.default_rng(7)
    base = int(rng.integers(0, 2**63))
    values = {base}
    while len(values) < 60:
        v = rng.choice(sorted(values))
        for b in rng.choice(64, size=rng.integers(0, 4), replace=False):
            v = int(v) ^ (1 << int(b))
        values.add(int(v))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), square).collect()
    found = {tuple(sorted((r.a, r.b))) for r in got}
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert found == want


def test_near_duplicates(docs):
    rng = random.Random(3)
    base = sentence(rng, 400)
    words = base.split()
    near = [" ".join(words[:k] + ["edited"] + words[k + 1 :]) for k in range(0, 400, 40)]
    texts = [None, "", "  ", base, base, *near, sentence(rng, 100), sentence(rng, 3), "a b"]
    rows = [(10 + i, t) for i, t in enumerate(texts)] + [(None, base), (12, "  ")]
    out = simhash.near_duplicates(docs(rows)).collect()
    assert len(out) == len(rows)
    fps = [brute_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in set(fps) for b in set(fps) if (a ^ b).bit_count() <= 2]
    root = roots(set(fps), links)
    want = Counter((i, min(j for (j, _), g in zip(rows, fps, strict=True) if root[g] == root[f] and j is not None)) for (i, _), f in zip(rows, fps, strict=True))
    assert Counter((r.doc_id, r.component_id) for r in out) == want
    assert simhash.near_duplicates(docs([])).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 100)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == roots(linked, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_shared_suffixes(seed):
    rng = random.Random(seed)
    depth = rng.choice([2, 3, 5, 8])
    strings = [bytes(rng.choice(b"ab" if rng.random() < 0.8 else b"abc\xfe") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 8))]
    strings += strings[: rng.randint(0, 1)]
    many = Counter(s[i : i + depth] for s in strings for i in range(len(s) - depth + 1))
    want = [[many[s[i : i + depth]] > 1 for i in range(len(s) - depth + 1)] for s in strings]
    symbols = [np.frombuffer(s, dtype=np.uint8).astype(np.uint16) + np.uint16(1) for s in strings]
    assert [x.tolist() for x in suffixes_shared(symbols, depth)] == want


def brute_removal(rows):
    texts = [(t or "").encode() for _, t in rows]
    many = Counter(b[s : s + 200] for b in texts for s in range(len(b) - 199))
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - 199):
            if many[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("large_group", [20_000, 2])
def test_repeated_bytes(docs, large_group):
    rng = random.Random(11)
    passage, other = sentence(rng, 120), sentence(rng, 60)
    texts = [None, "", "short", passage, passage, "x" * 700, "ab" * 450, f"{sentence(rng, 50)} {passage} {sentence(rng, 9)}", f"{passage[:199]}!{passage[200:]}", passage[3:203], passage[10:209]]
    texts += [f"{sentence(rng, 30)} {other} {sentence(rng, 30)} é {other[1:]}" for _ in range(6)] + [sentence(rng, 300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, passage), (3, passage)]
    out = substrings.remove_repeats(docs(rows), large_group=large_group).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out) == brute_removal(rows)


def test_no_repeated_bytes(docs):
    assert substrings.remove_repeats(docs([])).count() == 0
    (r,) = substrings.remove_repeats(docs([(1, sentence(random.Random(2), 200))])).collect()
    assert r.n_removed == 0 and r.n_spans == 0


def test_pieces_do_not_depend_on_parts(monkeypatch):
    rng = random.Random(4)
    text = (sentence(rng, 900) + " z" * 500 + sentence(rng, 300)).encode()
    whole = substrings.pieces(text)
    starts = lambda p: {s + k: h for h, s, n, _ in zip(*p, strict=True) for k in range(n)}
    monkeypatch.setattr(substrings, "PART", 333)
    assert starts(whole) == starts(substrings.pieces(text))
    assert sorted(starts(whole)) == list(range(len(text) - 199))


@pytest.mark.parametrize("seed", range(20))
def test_best_chain(seed):
    rng = random.Random(seed)
    pts = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(25)})
    x, y = (np.array(c) for c in zip(*pts, strict=True))
    f = []
    for i, (a, b) in enumerate(pts):
        f.append(chaining.K + max([0.0] + [f[j] - chaining.GAP_COST * (a - c + b - d) for j, (c, d) in enumerate(pts[:i]) if c < a and d < b]))
    chains = chaining.chains(x, y)
    used = [i for c in chains for i in c]
    assert len(used) == len(set(used))
    for c in chains:
        assert all(x[p] < x[q] and y[p] < y[q] for p, q in zip(c[:-1], c[1:], strict=True))
    score = lambda c: chaining.K * len(c) - chaining.GAP_COST * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]])
    if max(f) > chaining.K:
        assert abs(score(chains[0]) - max(f)) < 1e-6


def test_fuzzy_passages(docs):
    rng = random.Random(21)
    passage = sentence(rng, 90).split()
    fuzzy = [*passage[:20], "other", *passage[21:45], "in", "serted", *passage[45:70], *passage[71:]]
    short = sentence(rng, 40)
    text = {
        1: f"{sentence(rng, 60)} {' '.join(passage)} {sentence(rng, 50)}", 2: f"{sentence(rng, 30)} {' '.join(fuzzy)} {sentence(rng, 80)}", 3: f"{' '.join(passage).upper()} {sentence(rng, 20)}",
        4: sentence(rng, 400), 5: f"{sentence(rng, 50)} {short} {sentence(rng, 50)}", 6: f"{sentence(rng, 20)} {short} {sentence(rng, 90)}", 7: None, 8: "", 9: "one two", 10: sentence(rng, 120),
    }
    text[11] = text[10]
    rows = [*text.items(), (None, text[10])]
    out = chaining.repeated_passages(docs(rows)).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, 10, 11, None}
    for r in out:
        assert r.end_word - r.start_word >= 50 and r.similarity >= 0.8
    spans = {r.doc_id: (r.start_word, r.end_word) for r in out if r.doc_id in (1, 2, 3)}
    assert abs(spans[1][0] - 60) <= 1 and abs(spans[1][1] - 150) <= 1
    assert abs(spans[3][0] - 0) <= 1 and abs(spans[3][1] - 90) <= 1
    assert chaining.repeated_passages(docs([])).count() == 0


def test_every_exact_passage_is_found(docs):
    """Passages of exactly 50 words, at any place, in texts of different words."""
    rng = random.Random(8)
    rows, want = [], set()
    for i in range(0, 60, 2):
        passage = sentence(rng, 50)
        rows += [(i, f"{sentence(rng, rng.randint(0, 40))} {passage} {sentence(rng, rng.randint(0, 40))}"), (i + 1, f"{sentence(rng, rng.randint(0, 40))} {passage} {sentence(rng, rng.randint(0, 40))}")]
        want |= {i, i + 1}
    rows += [(1000 + i, sentence(rng, 130)) for i in range(30)]
    assert {r.doc_id for r in chaining.repeated_passages(docs(rows)).collect()} == want
