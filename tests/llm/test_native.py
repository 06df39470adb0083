"""Quality rules, license scan and sharding against plain Python."""

import re
import zlib
from collections import Counter

import pytest

from redlake.llm import license_scan, quality_rules, sharding

TEXTS = [
    None, "", "   \n\t", "one", "a b c a b c", "a b c d a b c e a b c", "x\ty\x0bz\r\nx y z", "# $ % word\nword", "Dup line.\nDup line.\n\nother\n \nDup line.",
    "no final mark", "We use of cookies here\nA good line of words that ends well.", "a | b | c | d", " ".join(["w%d" % (i % 7) for i in range(200)]), "é à ü é à ü",
    "word " * 3000, "Released under the MIT License.\nmit-license apache license General   Public/License", "mit license mit license", "xmit license amit licenses",
    "Licensed under the GNU General Public License version 3 or (at your option) any later version. all rights reserved",
    "This work is licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0",
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "one"), (3, "one")]


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs):
    out = quality_rules.clean_lines(docs(ROWS)).collect()
    assert len(out) == len(ROWS)
    for r in out:
        text = next(t for i, t in ROWS if i == r.doc_id)
        n = base_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, text
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.kept and r.base_failed)


def test_quality_lines(docs):
    good = "A line of plain words that ends as it should do in a text of some length, and goes on.\n" * 1
    body = "\n".join(" ".join(f"w{i}x{k}" for k in range(12)) + " ends." for i in range(8))
    menu = "\n".join(["home", "a | b | c | d | e", "click here"] * 40)
    rows = {r.doc_id: r for r in quality_rules.clean_lines(docs([(1, body), (2, body + "\nclick here"), (3, body + "\n" + menu), (4, good)])).collect()}
    assert rows[1].kept and rows[1].clean_text == body and rows[1].lost_chars == 0
    assert rows[2].kept and rows[2].clean_text == body and rows[2].n_boilerplate == 1
    assert not rows[3].kept and rows[3].n_navigation == 40 and rows[3].n_punctuation == 40 and rows[3].clean_text == body
    assert rows[4].base_failed


def brute_places(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    joined = " " + "  ".join(words) + " "
    places = []
    for o, rule in enumerate(license_scan.rules()):
        for m in re.finditer(rule["pattern"], joined):
            s = joined[: m.start()].count(" ") // 2
            places.append((s, s + m.group().count(" ") // 2, rule["priority"], o, rule["label"], rule["base"]))
    left = [
        d for d in places
        if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and (e[0], -e[1], -e[2], e[3]) < (d[0], -d[1], -d[2], d[3]) for e in places)
    ]
    return len(words), sorted(places), sorted(left)


def test_license_places(docs):
    assert len(license_scan.rules()) > 300
    out = license_scan.scan_licenses(docs(ROWS)).collect()
    for r in out:
        n, places, left = brute_places(next(t for i, t in ROWS if i == r.doc_id))
        assert r.n_words == n
        assert sorted(tuple(p) for p in r.places) == places
        assert sorted(tuple(p) for p in r.detections) == left


def sample(pattern):
    """A text that the pattern matches: options left out, first choices taken."""
    was = None
    while was != pattern:
        was = pattern
        pattern = re.sub(r"\(\?:[^()]*\)[?*]", "", pattern)
        pattern = re.sub(r"\(\?:([^()|]*)(\|[^()]*)?\)(?![?*])", r"\1", pattern)
    return " ".join(pattern.replace("v?", "").replace("[sc]", "s").split())


def test_every_rule_passes_the_gate(docs):
    rules = license_scan.rules()
    rows = [(o, sample(r["pattern"])) for o, r in enumerate(rules)]
    assert all(re.search(r["pattern"], " " + "  ".join(t.split()) + " ") for (_, t), r in zip(rows, rules, strict=True))
    for r in license_scan.scan_licenses(docs(rows)).collect():
        assert r.doc_id in {p.o for p in r.places}, rows[r.doc_id]


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", {"mit"}),
        ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        ("licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
        ("GPL-3.0-or-later", {"gpl-3.0-or-later"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
        ("under a Creative Commons Attribution-ShareAlike 4.0 licence", {"cc-by-sa-4.0"}),
        ("nothing of the kind", set()),
    ],
)
def test_license_labels(docs, text, labels):
    (r,) = license_scan.scan_licenses(docs([(1, text)])).collect()
    assert {d.label for d in r.detections} == labels


def test_shards(docs, spark):
    rows = [(i, f"text {i % 5}") for i in range(4000)] + [(None, None)] * 3 + [(7, "text 2")] * 500
    even = dict.fromkeys(range(16), 1.0)
    out = sharding.assign_shards(docs(rows), even, even | {16: 1.0}, parts=8).collect()
    assert len(out) == len(rows)
    of, sizes = {}, Counter()
    for r in out:
        assert of.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 16)
        sizes[r.shard] += 1
    for r in out:
        text = next(t for i, t in rows if i == r.doc_id)
        assert r.size == len((text or "").encode()) + 1
        if r.doc_id != 7:
            assert r.text_crc32 == zlib.crc32((text or "").encode())
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    moved = sum(g == 16 for _, g in of.values())
    assert 150 < moved < 340  # 4,000 / 17 in the mean
    counts = Counter(s for s, _ in of.values())
    assert max(counts.values()) < 1.4 * min(counts.values())


def test_shard_weights(docs):
    out = sharding.assign_shards(docs([(i, "") for i in range(6000)]), {0: 1.0, 1: 2.0, 2: 3.0}, parts=4).collect()
    counts = Counter(r.shard for r in out)
    assert abs(counts[2] - 3000) < 200 and abs(counts[1] - 2000) < 200


def test_empty_tables(docs):
    none = docs([])
    assert quality_rules.clean_lines(none).count() == 0
    assert license_scan.scan_licenses(none).count() == 0
    assert sharding.assign_shards(none, {0: 1.0}).count() == 0
