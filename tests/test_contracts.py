"""Behaviour on literal rows, and invariants on generated histories."""

import datetime as dt
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from redlake.functions import html, text, urls
from redlake.operators import delivery, graph, versions
from redlake.sources import blobs, state, tables
from redlake.streaming import streams

NOW = dt.datetime(2026, 1, 1, 12)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def captures(spark, rows):
    return spark.createDataFrame(rows, "key long, run long, semantic_sha256 string, html_sha256 string")


def test_versions_that_come_back_are_kept(spark):
    rows = [(1, 0, "a", "a1"), (1, 1, "a", "a1"), (1, 2, "b", "b1"), (1, 3, "a", "a1"), (1, 4, "a", "a2"), (2, 0, "a", "a1")]
    assert Counter((r.key, r.run, r.change) for r in versions.classify(captures(spark, rows)).collect()) == Counter(
        [(1, 0, "first"), (1, 1, "same"), (1, 2, "content"), (1, 3, "content"), (1, 4, "markup"), (2, 0, "first")]
    )
    assert sorted(r.run for r in versions.compact(captures(spark, rows[:4])).collect()) == [0, 2, 3]


def test_attachments_without_text_never_count_as_same(spark):
    rows = [(1, 0, "x", "t"), (1, 1, "y", "t"), (1, 2, "z", "u"), (2, 0, "x", ""), (2, 1, "y", ""), (2, 2, "y", "")]
    v = spark.createDataFrame(rows, "key long, run long, binary_sha256 string, text_sha256 string")
    assert [r.change for r in versions.classify_attachments(v).orderBy("key", "run").collect()] == ["first", "binary", "content", "first", "content", "same"]


def simulate(seen, last):
    active, missing, out = True, 0, []
    for run in range(min(seen), last + 1):
        if run in seen:
            if not active:
                out.append((run, "document_restored"))
            active, missing = True, 0
        elif active:
            missing += 1
            if missing == 2:
                active = False
                out.append((run, "document_removed"))
    return out


def histories(seed=1, keys=60, runs=25):
    rng = random.Random(seed)
    return {k: {r for r in range(runs) if rng.random() < 0.45} or {0} for k in range(keys)} | {999: {runs - 1}}


def test_presence_equals_a_simulation(spark):
    seen = histories()
    rows = [(k, r, "a", "a") for k, rs in seen.items() for r in rs]
    got = Counter((r.key, r.run, r.kind) for r in versions.presence(captures(spark, rows)).collect())
    assert got == Counter((k, r, kind) for k, rs in seen.items() for r, kind in simulate(rs, 24))
    kinds = {}
    for k, _, kind in sorted(got):
        assert kind == ("document_restored" if kinds.get(k) == "document_removed" else "document_removed")
        kinds[k] = kind
    streak = {r.key: (r.missing_runs, r.active) for r in versions.missing_streak(captures(spark, rows)).collect()}
    assert streak == {k: (min(24 - max(rs), 2), 24 - max(rs) < 2) for k, rs in seen.items()}


def test_streams_equal_batches(spark):
    rng = random.Random(2)
    rows = [(k, r, rng.choice("ab"), rng.choice("xy")) for k, rs in histories(3, 20, 12).items() for r in sorted(rs)]
    df = captures(spark, rows)
    got = streams.drained(streams.detect_changes(streams.replay(spark, df, "run")), "t")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, versions.classify(df).select("key", "run", "change").collect()))
    assert Counter(map(tuple, streams.presence_by_runs(streams.replay(spark, df, "run")).collect())) == Counter(map(tuple, versions.presence(df).collect()))


def test_late_captures_are_told_and_change_nothing(spark):
    from redlake.sources.tables import fresh_path

    path, source, schema = fresh_path(spark, "changes"), fresh_path(spark, "captures"), "key long, run long, semantic_sha256 string, html_sha256 string"

    def more(*rows):
        captures(spark, rows).write.mode("append").parquet(source)
        return {tuple(r) for r in streams.drained(streams.detect_changes(spark.readStream.schema(schema).parquet(source)), "changes", path=path).collect()}

    first = {(1, 3, "first"), (1, 5, "content")}
    assert more((1, 3, "a", "a"), (1, 5, "b", "b")) == first
    assert more((1, 4, "z", "z"), (1, 5, "b", "b"), (1, 6, "b", "c"), (2, 0, "a", "a")) == first | {(1, 4, "late"), (1, 5, "late"), (1, 6, "markup"), (2, 0, "first")}


def test_ledger_books_once(spark):
    pairs = [(i % 7, i % 3, i % 4) for i in range(60)]
    df = spark.createDataFrame(pairs, "event_id long, chat_id long, part long")
    for span in (1, 3, 1 << 20):
        got = Counter(map(tuple, streams.deliver_once(streams.replay(spark, df, "part").select("event_id", "chat_id"), span=span).collect()))
        assert got == Counter({(a, b) for a, b, _ in pairs})


def test_a_batch_reads_its_own_part_of_the_ledger(spark):
    from redlake.sources.tables import fresh_path

    path, df = fresh_path(spark, "ledger"), lambda *rows: spark.createDataFrame(rows, "event_id long, chat_id long")
    streams.book(path, df((1, 1), (25, 1), (99, 1), (None, 1)), 0, span=10)
    for _ in range(2):  # an attempt that is made again
        streams.book(path, df((1, 1), (1, 2), (1, 2), (55, 1)), 1, span=10)
    streams.book(path, df((1, 2), (2, 2)), 2, span=10)
    assert Counter(map(tuple, streams.ledger(spark, path).collect())) == Counter([(1, 1), (25, 1), (99, 1), (1, 2), (55, 1), (2, 2)])
    part = streams._booked(spark, path, [0, 4, 5], 2)
    assert {f.split("bucket=")[1][0] for f in part.inputFiles()} == {"0", "5"} and {tuple(r) for r in part.collect()} == {(1, 1), (1, 2), (55, 1)}
    assert "PartitionFilters" in part._jdf.queryExecution().executedPlan().toString()


def test_late_events_per_interval(spark):
    base = dt.datetime(2026, 1, 1)
    rows = [(1, i, f"v{i}", base + dt.timedelta(milliseconds=700 * i), i // 5) for i in range(40)]
    df = spark.createDataFrame(rows, "key long, id long, value string, at timestamp_ntz, part int")
    out = streams.drained(streams.latest_per_interval(streams.replay(spark, df, "part").select("key", "id", "value", "at"), "key", "value", "at", "id", late="0 seconds"), "w").collect()
    want = {}
    for _, i, v, at, _ in rows:
        want[int((at - base).total_seconds() // 2)] = v
    assert out and all(want[int((r.start.replace(tzinfo=None) - base).total_seconds() // 2)] == r.value for r in out)


EVENTS = "id long, created_at timestamp_ntz, document_id long, kind string, summary string, details string, notified boolean"


def events(spark, *rows):
    return spark.createDataFrame([(i, NOW, d, kind, s, "d", n) for i, d, kind, s, n in rows], EVENTS)


def test_known_errors_are_not_announced_again(spark):
    e = events(spark, (1, None, "fetch_error", "a", True), (2, None, "fetch_error", "a", False), (3, None, "fetch_error", "b", False), (4, None, "fetch_error", "b", False), (5, 7, "fetch_error", "a", False), (6, 7, "document_added", "a", False))
    assert sorted(r.id for r in delivery.new_errors(e).collect()) == [3, 5]


def test_a_new_documents_files_are_not_told(spark):
    e = events(spark, (1, 5, "attachment_added", "file", False), (2, 5, "document_added", "page", False), (3, 6, "attachment_added", "other", False), (4, None, "document_removed", "gone <b>", False))
    docs = spark.createDataFrame([(5, "T5", "Cat", "u5"), (6, "T6", "", "u6")], "id long, title string, category string, url string")
    told = delivery.with_documents(e, docs).withColumns({"severity": F.lit("warning"), "chat_id": F.lit(1)})
    (r,) = delivery.change_digest(told, ["chat_id"]).collect()
    assert r.n_events == 3
    assert r.text == (
        '🔔 Изменения: 3 событий\n\n📁 <b>Cat</b>\n<b>T5</b>\n🟠 page <code>document_added</code> · <a href="u5">открыть</a>'
        '\n\n📁 <b>Без категории</b>\n<b>T6</b>\n🟠 other <code>attachment_added</code> · <a href="u6">открыть</a>'
        "\n\n📁 <b>Без категории</b>\n<b>Общие события</b>\n🟠 gone &lt;b&gt; <code>document_removed</code>"
    )
    (many,) = delivery.change_digest(told.drop("document_id").withColumn("document_id", F.col("id")), ["chat_id"], groups=2).collect()
    assert many.text.endswith("… и ещё 2 документов. Подробности: /changes")


def test_fan_out_is_delivered_muted_or_told(spark):
    rng = random.Random(5)
    e = events(spark, *[(i, rng.choice([None, 1, 2, 3]), "document_removed", f"s{i}", False) for i in range(40)])
    docs = spark.createDataFrame([(1, "A", "Red", "u"), (2, "B", "Blue", "u"), (3, "C", "", "u")], "id long, title string, category string, url string")
    people = spark.createDataFrame([(i, 100 + i, "approved") for i in range(4)], "user_id long, chat_id long, status string")
    mutes = spark.createDataFrame([(0, "red"), (1, "blue")], "user_id long, category_key string")
    ledger = spark.createDataFrame([(i, 100 + i % 4) for i in range(0, 40, 3)], "event_id long, chat_id long")
    pairs = delivery.fan_out(delivery.with_documents(e, docs), people)
    left = delivery.undelivered(pairs, ledger)
    told, muted = delivery.muted(left, mutes, "left_anti").count(), delivery.muted(left, mutes).count()
    assert pairs.count() == 160 and told + muted + ledger.count() == 160 and muted
    assert delivery.delivery_complete(ledger.union(pairs.where("id = 9").select("id", "chat_id")), people).collect()[0].event_id == 9


def test_quota(spark):
    puts = spark.createDataFrame([("s", 1, "a", 2), ("s", 2, "b", 3), ("s", 3, "a", 2), ("s", 4, "c", 1), ("s", 5, "d", 1), ("t", 1, "a", 9)], "store string, seq long, digest string, len long")
    got = {(r.store, r.seq): (r.admitted, r.used) for r in blobs.quota_admission(puts, 3).collect()}
    assert got == {("s", 1): (True, 2), ("s", 2): (False, 2), ("s", 4): (True, 3), ("s", 5): (False, 3), ("t", 1): (False, 0)}
    assert blobs.usage(puts, 100).first().asDict() == {"n_objects": 4, "used_bytes": 7, "full": False}


def test_folds_take_keys_of_any_length(spark):
    """A million rows of one key, in order, in one pass that holds no array of them."""
    puts = spark.range(1_000_000).selectExpr("'s' as store", "id * 7 % 1000003 as seq", "cast(id as string) as digest", "id * 31 % 97 as len").union(spark.sql("select null, 5L, 'x', 3L"))
    out = blobs.quota_admission(puts, 5_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan
    got = [(r.admitted, r.used) for r in out.where("store = 's'").orderBy("seq").collect()]
    used, want = 0, []
    for _, n in sorted((i * 7 % 1000003, i * 31 % 97) for i in range(1_000_000)):
        fits = used + n <= 5_000
        used += n * fits
        want.append((fits, used))
    assert got == want and [tuple(r) for r in out.where("store is null").collect()] == [(None, 5, 3, True, 3)]
    assert blobs.quota_admission(puts.limit(0), 1).count() == 0


def test_notices_are_throttled(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 1, 1, 2]), i, NOW + dt.timedelta(seconds=rng.randint(0, 4000))) for i in range(500)]
    got = {(r.key, r.id): r.sent for r in versions.throttle(spark.createDataFrame(rows, "key long, id long, at timestamp_ntz")).collect()}
    last, want = {}, {}
    for k, i, at in sorted(rows, key=lambda r: (r[0] or 0, r[2], r[1])):
        want[k, i] = k not in last or at >= last[k] + dt.timedelta(seconds=60)
        if want[k, i]:
            last[k] = at
    assert got == want


def test_error_digests_are_cut_before_the_shuffle(spark):
    rows = [(i, NOW, None if i % 2 else i % 4, "fetch_error", f"s{i}", "d", False) for i in range(200)]
    out = delivery.error_digest(spark.createDataFrame(rows, EVENTS), ["document_id"])
    got = {r.document_id: (r.n_errors, r.text.split("\n")) for r in out.collect()}
    n, lines = got[None]
    assert n == 100 and len(lines) == 22 and lines[1] == "• fetch_error: s1 — d" and lines[20] == "• fetch_error: s39 — d" and lines[21] == "… и ещё 80"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[-1] or "WindowGroupLimit" in plan and "Partial" in plan


def files(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_the_store_keeps_one_object(spark, tmp_path):
    root, df = f"file://{tmp_path}/store", lambda *rows: spark.createDataFrame(rows, "seq long, data binary, suffix string").selectExpr("*", "'x' as digest", "1 as key")
    rows = [(1, b"abc", ".bin"), (2, b"abc", ".bin"), (3, b"abc", ""), (4, b"", None), (5, None, ".bin"), (6, bytes(range(256)) * 5000, ".odt")]
    keys = [r.key for r in blobs.put(df(*rows), root).collect()]
    there = files(tmp_path / "store")
    assert sorted(set(filter(None, keys))) == there and len(there) == 4 and keys.count(None) == 1
    times = {p: (tmp_path / "store" / p).stat().st_mtime_ns for p in there}
    (tmp_path / "store" / there[0]).parent.joinpath("_left-by-a-lost-task").write_bytes(b"half")
    blobs.put(df(*rows).repartition(4), root).collect()
    assert {p: (tmp_path / "store" / p).stat().st_mtime_ns for p in there} == times
    assert sorted(r.key for r in blobs.objects(spark, root).collect()) == there
    assert {(r.digest, r.suffix, r.len) for r in blobs.objects(spark, root).collect()} == {(hashlib.sha256(d).hexdigest(), s or "", len(d)) for _, d, s in rows if d is not None}
    asked = spark.createDataFrame([(k,) for k in [*keys, "00/00/" + "0" * 64, "no key"]], "key string")
    got = {r.key: r.data and bytes(r.data) for r in blobs.read(asked, root).collect()}
    assert got == {k: d for k, (_, d, _) in zip(keys, rows) if k} | {"00/00/" + "0" * 64: None, "no key": None} | {keys[3]: bytearray()}
    none = tmp_path / "none"
    assert blobs.objects(spark, f"file://{none}").count() == 0 and blobs.read(asked, f"file://{none}").where("data is null").count() == 6


def test_only_named_folders_are_read(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    keys = [r.key for r in blobs.put(spark.range(40).selectExpr("cast(cast(id as string) as binary) as data", "'' as suffix"), root).collect()]
    out = blobs.read(spark.createDataFrame([(keys[7],)], "key string"), root)
    assert [bytes(r.data) for r in out.collect()] == [b"7"]
    assert {f.rsplit("/", 3)[1] + "/" + f.rsplit("/", 3)[2] for f in out.inputFiles() if "/store/" in f} == {keys[7][:5]}


def test_puts_over_the_quota_write_nothing(spark, tmp_path):
    root, df = f"file://{tmp_path}/store", lambda *rows: spark.createDataFrame(rows, "seq long, data binary, suffix string")
    first = blobs.put_admitted(df((1, b"abc", ".bin"), (2, b"abc", ".bin")), root, 3).collect()
    assert {(r.seq, r.admitted) for r in first} == {(1, True), (2, True)} and len(files(tmp_path / "store")) == 1
    again = {r.seq: (r.admitted, r.key) for r in blobs.put_admitted(df((1, b"new", ".bin"), (2, b"abc", ".bin"), (3, b"", ".bin")), root, 3).collect()}
    assert again[1] == (False, None) and again[2] == (True, first[0].key) and again[3][0]
    assert len(files(tmp_path / "store")) == 2 and blobs.objects(spark, root).agg(F.sum("len")).first()[0] == 3


def test_odt_lines_stand_in_order():
    import io
    import zipfile

    def odt(body):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("content.xml", f'<o xmlns="u:o" xmlns:t="u:t">{body}</o>')
        return out.getvalue()

    assert html.odt_text(odt("<t:h>Head</t:h><t:p>a<t:s/>b <t:span>c</t:span>d</t:p>loose<t:p> </t:p>")) == "Head\na b c d"
    assert html.odt_text(odt("<t:table-row><t:c><t:p>x</t:p></t:c><t:c><t:p>y&amp;</t:p></t:c></t:table-row><t:p>z</t:p>")) == "x y&\nx\ny&\nz"
    assert html.odt_text(odt("<t:p>not closed")) == "" and html.odt_text(None) == "" and html.odt_text(b"PK") == ""


def test_upserts_keep_what_is_not_told(spark):
    old = spark.createDataFrame([(1, "T", "C", False), (2, "U", "D", False)], "id long, title string, category string, active boolean")
    new = spark.createDataFrame([(1, "", "C2"), (3, "N", "")], "id long, title string, category string")
    assert sorted(map(tuple, state.upsert_documents(old, new).collect())) == [(1, "T", "C2", True), (2, "U", "D", False), (3, "N", "", True)]


def test_old_tables_get_new_columns(spark):
    old = spark.createDataFrame([(1, "x")], "id long, etag string")
    assert tables.schema_upgrade(old, {"etag": "", "modified": ""}).first().asDict() == {"id": 1, "etag": "x", "modified": ""}
    path = tables.fresh_path(spark, "runs")
    for n in range(2):
        tables.append_run(spark, path, run_id=n, trigger="manual", baseline=False, documents=3, error="stopped" if n else "")
    assert sorted((r.run_id, r.error) for r in spark.read.parquet(path).collect()) == [(0, ""), (1, "stopped")]


def test_untouched_buckets_keep_their_files(spark):
    path, schema = tables.fresh_path(spark, "state"), "id long, title string, category string, active boolean"
    first = spark.createDataFrame([(i, f"t{i}", "c", True) for i in range(200)], schema)
    assert state.read_state(spark, path, schema).count() == 0
    state.update_state(first, path, ["id"], lambda _, rows: rows, schema, buckets=16)
    before = state.manifest(spark, path)[1]
    files_before = {f for f in state.read_state(spark, path, schema).inputFiles()}
    captured = spark.createDataFrame([(7, "", "new"), (8, "eight", ""), (1000, "n", "m")], "id long, title string, category string")
    wrote = state.update_state(captured, path, ["id"], state.upsert_documents, schema, buckets=16)
    version, after = state.manifest(spark, path)
    assert version == 1 and 1 <= len(wrote) <= 3 and {b for b in after if after[b] != before.get(b)} == set(wrote)
    kept = {f for f in state.read_state(spark, path, schema).inputFiles()} & files_before
    assert len(kept) >= 13 and all(f"/bucket={b}/" not in f for f in kept for b in wrote)
    rows = {r.id: (r.title, r.category, r.active) for r in state.read_state(spark, path, schema).collect()}
    assert len(rows) == 201 and rows[7] == ("t7", "new", True) and rows[8] == ("eight", "c", True) and rows[1000] == ("n", "m", True) and rows[9] == ("t9", "c", True)

    def lost(current, captured):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        state.update_state(captured, path, ["id"], lost, schema, buckets=16)
    assert state.manifest(spark, path) == (1, after)


def test_a_failing_run_leaves_its_row(spark):
    path, out = tables.fresh_path(spark, "log"), tables.fresh_path(spark, "out")
    rows = spark.range(10).withColumn("bad", F.col("id") % 4 == 0)
    counts = tables.logged(rows, path, lambda df: df.write.parquet(out), F.col("bad"), run_id=1, trigger="manual", baseline=True)
    assert counts == {"documents": 10, "errors": 3} and spark.read.parquet(out).count() == 10
    broken = rows.withColumn("x", F.raise_error(F.lit("no such page")).cast("string"))
    with pytest.raises(Exception, match="no such page"):
        tables.logged(broken, path, lambda df: df.write.parquet(f"{out}-2"), F.col("bad"), run_id=2, trigger="cron", baseline=False)
    got = {r.run_id: r for r in spark.read.schema(tables.RUN).parquet(path).collect()}
    assert (got[1].documents, got[1].errors, got[1].error, got[1].baseline) == (10, 3, "", True) and got[1].started_at <= got[1].finished_at
    assert got[2].documents is None and "no such page" in got[2].error and got[2].trigger == "cron"


def test_files_of_several_ages(spark):
    path, schema = tables.fresh_path(spark, "aged"), "id long, etag string, seen timestamp, n long"
    assert tables.read_versions(spark, path, schema, {}).count() == 0
    tables.append_version(spark.sql("select cast(1 as int) as id, 'gone' as old"), path, 1)
    tables.append_version(spark.sql("select 2L as id, cast(null as string) as etag, date'2024-01-02' as seen"), path, 2)
    tables.append_version(spark.sql("select 3000000000 as id, 'e' as etag, timestamp'2024-01-03 10:00:00' as seen, 5L as n"), path, 3)
    out = tables.read_versions(spark, path, schema, {"etag": "", "n": 0})
    assert out.schema.simpleString() == "struct<id:bigint,etag:string,seen:timestamp,n:bigint>"
    got = {r.id: (r.etag, r.seen and r.seen.day, r.n) for r in out.collect()}
    assert got == {1: ("", None, 0), 2: (None, 2, 0), 3000000000: ("e", 3, 5)}
    tables.append_version(spark.sql("select '4' as id"), path, 4)
    with pytest.raises(TypeError, match="id is string"):
        tables.read_versions(spark, path, schema, {})


def test_a_wide_walk_is_dealt_to_buckets(spark, monkeypatch):
    """10,000 pages, by broadcast and by merging."""
    edges = spark.range(1, 10_000).selectExpr("id div 8 as src", "id as dst").union(spark.range(1, 10_000, 7).selectExpr("id as src", "id div 8 as dst"))
    root, closed = spark.createDataFrame([(0,)], "node long"), spark.createDataFrame([(3,)], "node long")
    want = {0: 0}
    for i in range(1, 10_000):
        if i // 8 in want and i // 8 != 3:
            want[i] = want[i // 8] + 1
    for most in (100_000, 10):
        monkeypatch.setattr(graph, "BROADCAST_NODES", most)
        assert {r.node: r.depth for r in graph.bfs(graph.adjacency(edges, 8), root, closed).collect()} == want
    table_ = graph.adjacency(edges, 8)
    plan = table_.join(spark.range(9).selectExpr("id as src").repartition(8, "src").hint("merge"), "src", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1, "links stay where they lie"


def test_walk_ends_on_cycles(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (9, 8)], "src long, dst long")
    root, closed = spark.createDataFrame([(0,)], "node long"), spark.createDataFrame([(3,)], "node long")
    assert sorted(r.node for r in graph.bfs(edges, root, closed).collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="more than 2"):
        graph.bfs(edges, root, closed, max_nodes=2)


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTPS://A.b/c/?x=1#y", "https://A.b/c"), ("https://a.b", "https://a.b/"), ("https://a.b/?q", "https://a.b/"), ("https://a.b/x y/", "https://a.b/x y"), ("/p/q/", "/p/q")],
)
def test_canonical_urls(spark, url, want):
    assert value(spark, urls.canonicalize(F.lit(url))) == want


@pytest.mark.parametrize("href", ["http://x.y/z", "//x.y/z", "/z", "z", "#f", "?q=1", "", "../z", "./z/..", "a/../b"])
def test_joined_urls(spark, href):
    from urllib.parse import urljoin

    base = "https://h.test/a/b/c.html?k=1"
    assert value(spark, urls.url_join_any(F.lit(base), F.lit(href))) == urljoin(base, href)


@pytest.mark.parametrize(("url", "want"), [("https://h.t/docs/a/b", True), ("https://h.t/docs/a", False), ("https://h.t/docsx/a/b", False), ("https://h.t/docs/a/b/c", True)])
def test_document_urls(spark, url, want):
    assert value(spark, urls.is_document_url(F.lit(url), "https://h.t/docs/")) is want


def test_attachment_keys(spark):
    rows = [("Order 5.PDF", "u", "order 5"), ("  Order 5 .odt", "u", "order 5"), ("", "https://h.t/x/Plan.docx", "plan"), (None, "https://h.t/y/", ""), ("Plain", "u", "plain")]
    df = spark.createDataFrame(rows, "title string, url string, want string")
    assert all(r.got == r.want for r in df.select("want", urls.attachment_group_key(F.col("title"), F.col("url")).alias("got")).collect())


def test_white_space_as_python_has_it(spark):
    every = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    for c in every:
        assert value(spark, text.normalize_space(F.lit(f"{c}a{c}{c}b{c}"))) == "a b", hex(ord(c))
    assert value(spark, text.category_key(F.lit(" Straße ΣΑΣ "))) == " Straße ΣΑΣ ".strip().casefold()


@pytest.mark.parametrize(("s", "want"), [(-5, "0 с"), (59, "59 с"), (60, "1 мин 00 с"), (125, "2 мин 05 с"), (3600, "1 ч 00 мин"), (7380, "2 ч 03 мин")])
def test_durations(spark, s, want):
    assert value(spark, text.duration_label(F.lit(s))) == want


@pytest.mark.parametrize(
    ("mode", "at", "want"),
    [("noon", "2026-01-01 11:59:59", "2026-01-01 12:00:00"), ("noon", "2026-01-01 12:00:00", "2026-01-02 12:00:00"), ("midnight", "2026-01-01 00:00:00", "2026-01-02 00:00:00"), ("even", "2026-01-01 22:10:00", "2026-01-02 00:00:00"), ("even", "2026-01-01 10:00:00", "2026-01-01 12:00:00"), ("off", "2026-01-01 10:00:00", None)],
)
def test_slots(spark, mode, at, want):
    got = value(spark, text.next_slot(F.lit(at).cast("timestamp_ntz"), F.lit(mode)))
    assert (got and str(got)) == want


def test_chunks_and_bars(spark):
    assert value(spark, text.chunks(F.lit("abcdefg"), 3)) == ["abc", "def", "g"]
    assert value(spark, text.chunks(F.lit(""), 3)) == []
    assert value(spark, text.progress_bar(F.lit(25))) == "██" + "░" * 8
    assert value(spark, text.percent(F.lit(1), F.lit(0))) == 0
    assert value(spark, text.safe_filename(F.lit("..a b/ж?."), ".md")) == "a_b_ж.md"
    assert value(spark, text.html_escape(F.lit("<a & 'b'>\""))) == "&lt;a &amp; &#x27;b&#x27;&gt;&quot;"


def test_page_text():
    page = """<html><body><nav><a href="/n">n</a></nav><article><h1>T&nbsp; x</h1><p>one<p>two <b>bold</b><table><tr><td>a<td>b</table>
      <ul><li>x<li>y</ul><script>var t='</p>'</script><div class="tags">tag</div><p>end <a href="f.pdf">File</a></article></body></html>"""
    facts = html.page_facts(page, "https://h.t/a/b")
    assert facts["title"] == "T x" and facts["root_tag"] == "article"
    assert facts["semantic_text"] == "T x\none\ntwo bold\na | b\nx\ny\nend File"
    assert [(x["url"], x["in_root"]) for x in facts["links"]] == [("https://h.t/n", False), ("https://h.t/a/f.pdf", True)]
    assert "script" not in facts["normalized_html"] and "tag" not in facts["normalized_html"]
    assert html.page_facts(None, None)["semantic_text"] == ""
    assert html.odt_text(html.make_odt("a  b\n\nc & d")) == "a b\nc & d" and html.odt_text(b"no zip") == ""
