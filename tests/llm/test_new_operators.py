"""Archive conversion, resampling towards a target, alignment of tokenizers: against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redlake.llm import alignment, target_resampling, warc
from redlake.llm.common import table, written
from redlake.sources.tables import fresh_path

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def ngrams(t, most):
    w = WORDS.findall(lowered(t))
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def drawn(rows, target, most, buckets, percent, least):
    def hashed(t):
        return Counter(zlib.crc32(f.encode()) % buckets for f in ngrams(t, most))

    raw, wanted = Counter(), Counter()
    for _, t in rows:
        raw += hashed(t)
    for t in target:
        wanted += hashed(t)
    s_all, t_all, out = raw.total(), wanted.total(), []
    for i, t in rows:
        f = hashed(t)
        total = sum(n * math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b, n in f.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = total // f.total() if f else 0
        out.append([i, len(WORDS.findall(lowered(t))), f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(long[: percent * len(long) // 100]):
        r[5] = place + 1
    return Counter(map(tuple, out))


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="aBz09 \n\t-é漢_'\x7f\x00", max_size=40), st.integers(1, 4))
def test_spans_are_the_ngrams(t, most):
    n, counts = target_resampling.bucket_counts(t, most, 1000)
    assert n == len(WORDS.findall(lowered(t))) and counts == Counter(zlib.crc32(f.encode()) % 1000 for f in ngrams(t, most))


@pytest.mark.parametrize(("most", "percent"), [(1, 10), (3, 40)])
def test_draw_is_brute_force(spark, docs, most, percent):
    rng = random.Random(most)
    vocabulary = ["Alpha", "beta", "Gamma-ray", "漢字", "x9", "été", "de", "ZZ"]
    rows = [(i, rng.choice([" ", "\n", ", "]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(150)]
    rows += [(7, rows[7][1])] * 5 + [(None, rows[9][1])] * 3 + [(200, None), (201, ""), (202, " .,- "), (203, "word " * 30_000), (204, "long" * 50_000)]
    target = ["alpha beta x9", "beta beta", None, ""]
    out = target_resampling.resample_to_target(docs(rows), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), percent, 20, most, 500).collect()
    assert Counter(map(tuple, out)) == drawn(rows, target, most, 500, percent, 20)


def test_draw_of_nothing(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert target_resampling.resample_to_target(docs([(1, "a b")]).limit(0), none).count() == 0
    (row,) = target_resampling.resample_to_target(docs([(1, "a b")]), none).collect()
    assert (row.n_features, row.rank) == (2, None)


PAGES = [
    (3, "http://a.example/x y", "<p>one</p>"),
    (1, "http://a.example/", "<p>two</p>"),
    (9, "http://b.example/", "<p>one</p>"),
    (9, "http://b.example/", "<p>one</p>"),
    (None, None, "<p>one</p>"),
    (4, "-", None),
    (5, "", ""),
    (6, "http://c.example/\n\t\x7f", "\r\n\r\nWARC/1.1\r\nHTTP/1.1 200 OK\r\n\r\nhttp://x 0.0.0.0 20000101000000 text/html 3\n"),
    (7, "http://d.example/é", "漢字" * 100_000),
]


def through(spark, pages, **how):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as date", "'z' as payload", "2 as archive", "'q' as first")
    return df, warc.archive_pages(df, **how)


@pytest.mark.parametrize("how", [{}, {"versions": (1,)}, {"versions": (2,), "most": 0}, {"archive_bytes": 300}, {"least_bytes": 11}])
def test_archives_hold_every_page(spark, how):
    _, out = through(spark, PAGES, **how)
    rows = out.collect()
    least = how.get("least_bytes", 0)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in rows) == Counter((i, len((h or "").encode()), warc.digest((h or "").encode())) for i, _, h in PAGES)
    firsts = {}
    for i, _, h in PAGES:
        firsts[h or ""] = min(firsts.get(h or "", 1 << 60), 1 << 60 if i is None else i)
    for r in rows:
        same = [h for h in firsts if warc.digest(h.encode()) == r.payload_digest][0]
        if r.record_type == "revisit":
            assert r.refers_to == firsts[same] and r.payload_bytes >= least
            (to,) = [x for x in rows if x.record_id == r.refers_to_id]
            assert to.record_type == "response" and (to.page_id, to.payload_digest) == (r.refers_to, r.payload_digest)
        else:
            assert r.refers_to is None and r.refers_to_id is None
    sizes = [len((h or "").encode()) for _, _, h in PAGES]
    assert sum(r.record_type == "response" for r in rows) == sum(n < least for n in sizes) + sum(len(h.encode()) >= least for h in firsts)
    assert len({r.record_id for r in rows}) == len(rows) and {r.date for r in rows} == {"2000-01-01T00:00:00Z"}


def test_payloads_come_back(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    arc, out = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    warc.write_arc(df, arc, archive_bytes=2000)
    warc.convert(spark, arc, out, archive_bytes=2000)
    found = warc.read_warc(spark, out, with_payload=True).collect()
    assert {r.payload_digest: bytes(r.payload).decode() for r in found if r.record_type == "response"} == {warc.digest((h or "").encode()): h or "" for _, _, h in PAGES}
    assert {r.url for r in found} == {"http://a.example/x%20y", "http://a.example/", "http://b.example/", None, "%2D", "", "http://c.example/%0A%09%7F", "http://d.example/é"}


def test_no_pages_no_records(spark):
    _, out = through(spark, [])
    assert out.count() == 0


def arc(version, *records):
    about = f"{version} 0 test\n{warc.ARC_FIELDS[version]}\n\n".encode()
    more = b" 200 - - 0 t.arc" if version == 2 else b""
    return b"filedesc://t.arc 0.0.0.0 20010203040506 text/plain%s %d\n%s" % (more, len(about), about) + b"".join(b"\n%s %d\n%s" % (h, len(b), b) for h, b in records)


def test_header_lines_of_each_version():
    one = arc(1, (b"http://a/ b c 1.2.3.4 20010203040506 text/html", b"HTTP/1.0 404 Not Found\r\n\r\nbody"), (b"dns:a 1.2.3.4 20010203040507 text/dns", b"\n\na A 1.2.3.4\n\n"))
    two = arc(2, (b"http://a/\xff - 20010203040506 image/gif 302 ABC http://b/ 77 t.arc", b"\x00\xff\n"), (b"x:y 1.2.3.4 20010203040506 - - - - 99 t.arc", b""))
    a, b = warc.parse_arc(one)
    assert a[:5] == ("http://a/ b c", "1.2.3.4", "20010203040506", "text/html", None) and warc.http_parts(a.block) == (b"HTTP/1.0 404 Not Found\r\n\r\n", b"body")
    assert b[:5] == ("dns:a", "1.2.3.4", "20010203040507", "text/dns", None) and b.block == b"\n\na A 1.2.3.4\n\n"
    c, d = warc.parse_arc(two)
    assert c[:5] == ("http://a/%FF", None, "20010203040506", "image/gif", 302) and c.block == b"\x00\xff\n"
    assert d[:5] == ("x:y", "1.2.3.4", "20010203040506", None, None) and d.block == b""
    assert list(warc.parse_arc(b"")) == []


@pytest.mark.parametrize("damage", [lambda a: a[:-1], lambda a: a.replace(b"text/html", b"text html", 1).replace(b"20010203040506 text html", b"x text html"), lambda a: a[30:], lambda a: a.replace(b"\n1 0", b"\n3 0")])
def test_damage_is_an_error(damage):
    with pytest.raises(ValueError, match="before byte"):
        list(warc.parse_arc(damage(arc(1, (b"http://a/ 1.2.3.4 20010203040506 text/html", b"body")))))


def test_legacy_files_of_others(spark, tmp_path):
    """Uncompressed archives that hold other things than HTTP responses."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(arc(1, (b"dns:a 1.2.3.4 20010203040507 text/dns", b"a A 1.2.3.4"), (b"http://a/ 1.2.3.4 20010203040506 text/html", b"HTTP/1.0 200 OK\nA: b\n\nbody")))
    (tmp_path / "in" / "b.arc").write_bytes(arc(2, (b"http://b/ 1.2.3.4 20020203040506 text/html 200 - - 0 t.arc", b"HTTP/1.0 200 OK\r\n\r\nbody")))
    warc.convert(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    rows = {r.url: r for r in warc.read_warc(spark, f"file://{tmp_path}/out").collect()}
    assert (rows["dns:a"].record_type, rows["dns:a"].payload_bytes, rows["dns:a"].date) == ("resource", 11, "2001-02-03T04:05:07Z")
    assert rows["http://a/"].record_type == "response" and rows["http://b/"].record_type == "revisit"
    assert rows["http://b/"].refers_to_id == rows["http://a/"].record_id and rows["http://b/"].payload_bytes == 4


@lru_cache(1)
def tokenizers():
    """(encode, bytes of an id) of each, by the libraries, whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    letters = {v: k for k, v in byte_alphabet().items()}
    return (
        lambda t: a.encode(" " + t, add_special_tokens=False).ids,
        lambda i: bytes(letters[c] for c in a.id_to_token(i)),
        lambda t: b.encode(t),
        lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode(),
    )


def byte_alphabet():
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    more = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(more)) for b in range(256)}


def by_hand(t):
    """(a ids, b ids, groups, linked pairs) of a text, by the offsets where both end."""
    encode_a, bytes_a, encode_b, bytes_b = tokenizers()
    a, b = (encode_a(t), encode_b(t)) if t else ([], [])
    if not t or not b"".join(map(bytes_a, a)) == b"".join(map(bytes_b, b)) == (" " + t).encode():
        return [], [], [], []
    ends_a, ends_b = np.cumsum([len(bytes_a(i)) for i in a]).tolist(), np.cumsum([len(bytes_b(i)) for i in b]).tolist()
    both, groups, i, j, links = set(ends_a) & set(ends_b), [], 0, 0, []
    for end in sorted(both):
        k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append((a[i:k], b[j:m]))
        links.append((a[k - 1], b[m - 1]))
        i, j = k, m
    return a, b, groups, links


def in_writing(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


ODD = ["Hello world", " two  spaces", "line\n\n  indented\n", "trail \n ", " ", "\n", "a\u2581b is not a space", "<|endoftext|> <s> </s> <unk>", "naïve café — “quotes”…", "漢字かな交じり文です 漢字", "👍🏽 emoji👩‍👩‍👧", "x\u2003y\u00a0z\x85w\x1c v", "don't we'll I'M", "ÅÄÖ ﬁ ﬂ ①②", "\x00 nul", "tab\tseparated  \t values", "a" * 3000, "word " * 500, "1234567890 " * 3, "if (x):\n    return  y\n\n\n", None, "", "זה עברית", "\ufeffbom", "a\u200b b\u2060 c"]


def test_texts_align_as_the_libraries_say():
    x = alignment.Aligner(alignment.PATH_A, alignment.PATH_B)
    assert x.cut and x.ranked is not None
    sizes, groups, owner, pair, times = x.align(ODD)
    for k, t in enumerate(ODD):
        a, b, g, links = by_hand(t)
        assert (sizes[k].tolist(), groups[k]) == ([len(a), len(b), len(g), len(links)], in_writing(g)), t
        assert {int(p): int(n) for o, p, n in zip(owner, pair, times) if o == k} == Counter(p << 32 | q for p, q in links)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "é", "漢", "'s", "1", ".", "\u2581", "\xa0", "\x1c", "\u3000", "👍", "ing", "Hello", "\x85", "<s>"]), max_size=12).map("".join))
def test_parts_are_independent(t):
    x = known()
    sizes, groups, *_ = x.align([t])
    a, b, g, _ = by_hand(t)
    assert (sizes[0, :2].tolist(), groups[0]) == ([len(a), len(b)], in_writing(g))


@lru_cache(1)
def known():
    return alignment.Aligner(alignment.PATH_A, alignment.PATH_B)


def test_letters_of_ranked_parts_are_cut_as_the_library_cuts():
    x, encode = known(), tokenizers()[0]
    letters = [chr(c) for c in range(0x3000) if alignment._SURE.fullmatch(chr(c))]
    assert len(letters) > 700
    for c in letters:
        for t in (f"a{c}", f"1{c}b", f".{c}", f"b {c}x", f"{c}{c}1", f"'{c}s"):
            assert x.ranked.encode_ordinary(" " + t) == encode(t), (t, hex(ord(c)))


@settings(deadline=None, max_examples=100)
@given(st.lists(st.tuples(st.integers(1, 4), st.booleans()), min_size=1, max_size=40))
def test_groups_and_overlaps(cuts):
    """Two ways to cut a string: groups end where both cut, overlaps are all pairs that share a byte."""
    length = sum(n for n, _ in cuts)
    a = np.array([(i, min(i + 3, length)) for i in range(0, length, 3)])
    ends = np.cumsum([n for n, _ in cuts])
    b = np.stack([ends - [n for n, _ in cuts], ends], axis=1)
    both = sorted(set(a[:, 1].tolist()) & set(ends.tolist()))
    group_a, group_b = alignment.groups_of(a, b)
    assert group_a.tolist() == [sum(e <= s for e in both) for s in a[:, 0]] and group_b.tolist() == [sum(e <= s for e in both) for s in b[:, 0]]
    i, j = alignment.overlaps(a, b)
    assert list(zip(i, j)) == [(p, q) for p in range(len(a)) for q in range(len(b)) if a[p, 0] < b[q, 1] and b[q, 0] < a[p, 1]]


@pytest.mark.parametrize("frequent", [0, 20, 100_000])
def test_alignment_is_brute_force(spark, docs, frequent):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").limit(120).collect()]
    rows = [*enumerate(texts), (5, texts[5]), (None, texts[3])] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000 + i, "the same words") for i in range(200)]
    every = [(i, *by_hand(t)) for i, t in rows]
    counts = Counter(p for *_, links in every for p in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = Counter(
        (i, len(a), len(b), len(g), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(in_writing(g).encode()).hexdigest() if g else "") for i, a, b, g, links in every
    )
    aligned = written(alignment.align_texts(docs(rows)), "aligned")
    out = alignment.alignment_scores(aligned, frequent).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(map(tuple, out.collect())) == want
    assert alignment.alignment_scores(written(alignment.align_texts(docs(rows).limit(0)), "none")).count() == 0
