"""Page text against what generated pages were made of; diffs applied again; deep and broken pages."""

import random
from html import escape

from pyspark.sql import functions as F

from redlake.functions import html
from redlake.operators import graph
from redlake.streaming import streams


def made(rng):
    """A page, its lines of text and its normalized content."""
    word = lambda: "".join(rng.choice("abc<&é\xa0") for _ in range(rng.randint(1, 6))).replace("\xa0", "z\xa0z")
    page, lines, kept = [], [], []

    def inline():
        pieces, marked, plain = [], [], []
        for _ in range(rng.randint(1, 4)):
            w = word()
            tag = rng.choice(["", "b", "span", "a"])
            open_ = {"": "", "b": '<b class="x">', "span": "<span>", "a": f'<a href="/{escape(w)}" id="i">'}[tag]
            normal = {"": "", "b": "<b>", "span": "", "a": f'<a href="/{escape(w)}">'}[tag]
            marked.append(open_ + escape(w) + (f"</{tag}>" if tag else ""))
            plain.append(normal + escape(w, quote=False) + (f"</{tag}>" if tag in ("b", "a") else ""))
            pieces.append(w)
        return " ".join(marked), html.clean(" ".join(pieces)), " ".join(plain)

    for _ in range(rng.randint(1, 8)):
        kind = rng.choice(["p", "h2", "ul", "table", "script", "noise", "div"])
        if kind in ("p", "h2"):
            m, t, n = inline()
            page.append(f"<{kind} style='x'>{m}</{kind}>")
            lines.append(t)
            kept.append(f"<{kind}>{n}</{kind}>")
        elif kind == "ul":
            items = [inline() for _ in range(3)]
            page.append("<ul>" + "".join(f"<li>{m}</li>" for m, _, _ in items) + "</ul>")
            lines += [t for _, t, _ in items]
            kept.append("<ul>" + "".join(f"<li>{n}</li>" for _, _, n in items) + "</ul>")
        elif kind == "table":
            cells = [inline() for _ in range(2)]
            page.append("<table><tr>" + "".join(f'<td rowspan="2" width="9">{m}</td>' for m, _, _ in cells) + "</tr></table>")
            lines.append(" | ".join(t for _, t, _ in cells))
            kept.append("<table><tr>" + "".join(f'<td rowspan="2">{n}</td>' for _, _, n in cells) + "</tr></table>")
        elif kind == "div":
            m, _, n = inline()
            page.append(f"<div>{m}</div>")
            kept.append(f"<div>{n}</div>")
        else:
            page.append("<script>var p = '<p>no</p>'</script>" if kind == "script" else '<div class="tags"><p>no</p></div>')
    return f"<html><body><nav><p>no</p></nav><article>{''.join(page)}</article></body></html>", "\n".join(x for x in lines if x), "".join(kept)


def test_generated_pages(spark):
    rng = random.Random(1)
    pages = [made(rng) for _ in range(400)]
    df = spark.createDataFrame([(i, "https://h.t/x", p) for i, (p, _, _) in enumerate(pages)], "page_id long, url string, html string")
    for r in html.parse_pages(df, "semantic_text", "normalized_html", "root_tag").collect():
        assert (r.semantic_text, r.normalized_html, r.root_tag, r.error) == (*pages[r.page_id][1:], "article", None)


def shape(node):
    return [c if isinstance(c, str) else (c.name, *shape(c)) for c in node.children]


def test_broken_pages_have_the_tree_their_authors_meant():
    for page, want in (
        ("<p>a<p>b</p>c", [("p", "a"), ("p", "b"), "c"]),
        ("<ul><li>a<li>b<p>c</ul>d", [("ul", ("li", "a"), ("li", "b", ("p", "c"))), "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", [("table", ("tr", ("td", "a"), ("td", "b")), ("tr", ("td", "c"))), "d"]),
        ("<b><p>x</b>y</p>z", [("b", ("p", "x")), "yz"]),
        ("<div><b>x</div>y</b>z", [("div", ("b", "x")), "yz"]),
        ("<b><div>x</b>y</div>z", [("b", ("div", "xy"), "z")]),
        ("<div><table><tr><td>a</div>b</td></tr></table>c</div>d", [("div", ("table", ("tr", ("td", "ab"))), "c"), "d"]),
        ("<table><tr><td><span>a</table>b", [("table", ("tr", ("td", ("span", "a")))), "b"]),
        ("<div><p>a</section></span>b</div>c", [("div", ("p", "ab")), "c"]),
        ("a</p>b</table>c<br>d<br/>e", ["abc", ("br",), "d", ("br",), "e"]),
        ("<table><tr><td><p>a<div>b</td><td>c</table>", [("table", ("tr", ("td", ("p", "a"), ("div", "b")), ("td", "c")))]),
    ):
        joined = lambda nodes: [(n[0], *joined(n[1:])) if isinstance(n, tuple) else n for n in merged(nodes)]
        assert joined(shape(html.parse(page))) == want, page


def merged(nodes):
    out = []
    for n in nodes:
        if isinstance(n, str) and out and isinstance(out[-1], str):
            out[-1] += n
        else:
            out.append(n)
    return out


def test_content_roots():
    text = lambda n: "t " * n
    inner = f'<div class="item-page"><div class="com-content-article__body">{text(9)}</div>{text(3)}</div>'
    assert html.page_facts(f"<body><main>{text(2)}</main>{inner}</body>", "", ("root_tag", "root_chars")) == {"root_tag": "div", "root_chars": len(" ".join([text(9).strip(), text(3).strip()]))}
    two = f'<div class="com-content-article__body">{text(2)}</div>{inner}'
    assert html.page_facts(f"<body>{two}</body>", "", ("root_chars",))["root_chars"] > len(text(9))
    script = f"<body><article>{text(2)}<script>{text(50)}</script></article><main>{text(9)}</main></body>"
    assert html.page_facts(script, "", ("root_tag",))["root_tag"] == "main"
    assert html.page_facts(f"<body><article>{text(1)}</article><main><article>{text(8)}</article></main></body>", "", ("root_chars",))["root_chars"] == len(text(8).strip())


def test_deep_pages_keep_their_facts(spark):
    deep = "<div>" * 20_000 + "<p>deep down</p>" + "</div>" * 20_000
    df = spark.createDataFrame([(1, "u", deep), (2, "u", None), (3, "u", "<p>a<p>b")], "page_id long, url string, html string")
    got = {r.page_id: (r.semantic_text, r.error) for r in html.parse_pages(df, "semantic_text", "normalized_html").collect()}
    assert got == {1: ("deep down", None), 2: ("", None), 3: ("a\nb", None)}


def patched(old, diff):
    lines, out, at = old.splitlines(), [], 0
    for line in diff.split("\n")[2:]:
        if line.startswith("@@"):
            start, _, count = line.split()[1][1:].partition(",")
            first = int(start) - (count != "0")
            out += lines[at:first]
            at = first
        elif line[:1] in (" ", "-"):
            assert lines[at] == line[1:]
            out += [line[1:]] * (line[0] == " ")
            at += 1
        else:
            out.append(line[1:])
    return out + lines[at:]


def test_diffs_lead_from_old_to_new(spark):
    rng = random.Random(2)
    pairs = []
    for i in range(300):
        old = [rng.choice("abcdef") for _ in range(rng.randint(0, 25))]
        new = [x for x in old if rng.random() > 0.2]
        for _ in range(rng.randint(0, 3)):
            new.insert(rng.randint(0, len(new)), rng.choice("xyz"))
        pairs.append((i, "\n".join(old), "\n".join(new)))
    df = spark.createDataFrame(pairs, "id long, old string, new string")
    for r in df.select("*", html.diff_of("old", "new").alias("diff")).collect():
        assert (patched(r.old, r.diff) if r.diff else r.old.splitlines()) == r.new.splitlines()


def test_documents_are_leaves(spark):
    links = [("r", "a", False), ("r", "d1", True), ("a", "r", False), ("a", "b", False), ("a", "d2", True), ("b", "d3", True), ("d1", "c", False), ("c", "d4", True)]
    df = spark.createDataFrame(links, "src string, dst string, is_document boolean")
    root, muted = spark.createDataFrame([("r",)], "node string"), spark.createDataFrame([("b",)], "node string")
    assert {r.node for r in graph.discover(df, root, muted).collect()} == {"d1", "d2"}


def test_presence_goes_on_where_it_was(spark):
    """A second start on the same folder handles only what is new."""
    from redlake.sources.tables import fresh_path

    path, source = fresh_path(spark, "presence"), fresh_path(spark, "captures")
    df = lambda rows: spark.createDataFrame(rows, "key long, run long")
    stream = lambda: spark.readStream.schema("key long, run long").parquet(source)
    df([(1, 0), (2, 0), (1, 1)]).write.mode("append").parquet(source)
    assert not streams.presence_by_runs(stream(), path=path).collect()
    df([(1, 5), (2, 1)]).write.mode("append").parquet(source)
    got = [tuple(r) for r in streams.presence_by_runs(stream(), path=path).collect()]
    assert sorted(got) == [(1, 3, "document_removed"), (1, 5, "document_restored"), (2, 3, "document_removed")]
    df([(3, 6), (2, 6), (2, 6)]).write.mode("append").parquet(source)
    assert sorted(map(tuple, streams.presence_by_runs(stream(), path=path).collect())) == sorted([*got, (2, 6, "document_restored")])
    df([(3, 9)]).write.mode("append").parquet(source)
    assert sorted(map(tuple, streams.presence_by_runs(stream(), path=path).collect())) == sorted([*got, (2, 6, "document_restored"), (1, 7, "document_removed"), (2, 8, "document_removed"), (3, 8, "document_removed"), (3, 9, "document_restored")])
