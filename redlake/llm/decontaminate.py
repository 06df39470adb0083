"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders; windows of template words are joined
by hash with those of the benchmark; what stands in the slots of the windows found tells an
exact copy from a question asked again with other parameters, and both from chance. Windows
of the benchmark with too few words that aren't placeholders are joined as they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bind, hinted, table, written

WINDOW = 8
#: A window of the benchmark with fewer words that aren't placeholders says too little as a template; one of fewer words says too little at all.
MIN_PLAIN = 4
#: A document is contaminated by an item if it has this share of the item's windows.
MIN_COVERAGE = 0.3
#: Matched windows this far apart in a document belong to different occurrences of an item.
RUN_GAP = 2 * WINDOW
#: Windows of a benchmark are broadcast only if they are this few.
BROADCAST_WINDOWS = 200_000
# Placeholders, and what becomes one. Fixed values.
NUMBER, NAME, UNIT = "zznum", "zzname", "zzunit"
UNITS = (
    "km|cm|mm|kg|mg|ml|mi|ft|in|lb|lbs|oz|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|meters|metres|miles|litres|liters|dollars|euros|euro|percent|points|degrees|km2|m2|m|g|l|h|s"
    "|heures|heure|secondes|seconde|jours|jour|semaines|semaine|mois|ans|an|mètres|mètre|kilomètres|degrés"
    "|Stunden|Stunde|Minuten|Sekunden|Tage|Tagen|Tag|Wochen|Woche|Monate|Monaten|Jahre|Jahren|Jahr|Meter|Kilometer|Liter|Euro|Prozent|Grad"
    "|horas|hora|minutos|minuto|segundos|segundo|días|día|semanas|semana|meses|mes|años|año|metros|kilómetros|litros|grados"
)
_DIGITS = r"(?<=\d)[.,:/](?=\d)"
_NAME = r"(?<![\p{L}\p{N}_])\p{Lu}\p{Ll}+(?![\p{L}\p{N}_])"
_NUMBER_UNIT = rf"(?<![\p{{L}}\p{{N}}_])\d[\d_]*( ?)(?:{UNITS})(?![\p{{L}}\p{{N}}_])"
_NUMBER = r"(?<![\p{L}\p{N}_])\d[\d_]*(?![\p{L}\p{N}_])"
_GAP = r"[^\p{L}\p{N}_]+"


def _raw(text: Column) -> Column:
    """One token a number, with its unit if that is written to it."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(r"\d"), F.regexp_replace(text, _DIGITS, "_")).otherwise(text)


def _template(raw: Column) -> Column:
    """raw with placeholders, in lower case: as many words as before. Each capitalised word is a name, wherever it stands."""
    with_units = F.regexp_replace(F.regexp_replace(raw, _NUMBER_UNIT, f"{NUMBER}$1{UNIT}"), _NUMBER, NUMBER)
    return F.lower(F.regexp_replace(F.when(raw.rlike(r"\d"), with_units).otherwise(raw), _NAME, NAME))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _GAP), lambda w: w != "")


def _both(text: Column) -> Column:
    """t, the words of the template, and r, the words as written, in lower case."""
    return bind(_raw(text), lambda raw: F.struct(_words(_template(raw)).alias("t"), _words(F.lower(raw)).alias("r")))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _window(hashes: Column, at: Column, width: Column, raw: Column) -> Column:
    return F.xxhash64(F.slice(hashes, at + 1, width), width, raw)


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id, h, at, width, raw, t, r, n_windows, least): one row for each place of a window of an item that says enough.

    width is the number of the window's words, fewer than `width` in a short item; raw: it is
    joined as written; least marks one place of each different window, the one with the
    smallest words.
    """
    cut = benchmark.select("item_id", _both(F.col("text")).alias("x")).select("item_id", "x.t", "x.r", F.least(F.lit(width), F.size("x.t")).alias("width"))
    each = cut.where(F.col("width") >= MIN_PLAIN).select("item_id", "t", "r", "width", F.explode(F.sequence(F.lit(0), F.size("t") - F.col("width"))).alias("at"))
    part = each.withColumns({c: F.slice(c, F.col("at") + 1, F.col("width")) for c in "tr"})
    plain = F.size(F.filter("t", lambda w: ~w.isin(NUMBER, NAME, UNIT, NUMBER + UNIT)))
    told = part.withColumn("raw", plain < MIN_PLAIN)
    told = told.withColumn("h", _window(_hashes(F.when(F.col("raw"), F.col("r")).otherwise(F.col("t"))), F.lit(0), F.col("width"), F.col("raw")))
    first = F.row_number().over(Window.partitionBy("item_id", "h").orderBy("r", "at"))
    counts = told.groupBy("item_id").agg(F.countDistinct("h").alias("n_windows"))
    return told.withColumn("least", first == 1).join(counts.hint("merge"), "item_id")


def _hits(d: DataFrame, items: DataFrame) -> DataFrame:
    """(digest, pos, width, h), written: windows of the texts (digest, text) that the benchmark has.

    Texts have windows of WINDOW words, and of the fewer words of short items; windows as
    written only if the benchmark has such.
    """
    cuts = sorted((r.width, r.raw) for r in items.select("width", "raw").distinct().collect())  # at most WINDOW times two
    if not cuts:
        return d.select("digest", F.lit(0).alias("pos"), F.lit(0).alias("width"), F.lit(0).cast("long").alias("h")).limit(0)

    def cut(words: Column, width: int, raw: bool) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.struct(i.alias("pos"), F.lit(width).alias("width"), _window(words, i, F.lit(width), F.lit(raw)).alias("h")))
        return F.when(F.size(words) >= width, each).otherwise(F.array().cast("array<struct<pos:int,width:int,h:long>>"))

    def windows(x: Column) -> Column:
        return F.concat(*(cut(x.r if raw else x.t, width, raw) for width, raw in cuts))

    need = [_hashes(_words(_template(F.col("raw")))).alias("t"), (_hashes(_words(F.lower(F.col("raw")))) if any(raw for _, raw in cuts) else F.lit(None)).alias("r")]
    each = d.select("digest", _raw(F.col("text")).alias("raw")).select("digest", F.explode(bind(F.struct(*need), windows)).alias("w")).select("digest", "w.pos", "w.width", "w.h")
    known = written(items.select("h").distinct(), "benchmark-hashes")
    return written(each.join(hinted(known, BROADCAST_WINDOWS), "h", "left_semi").distinct(), "hits")


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, item_id, n_matched, n_windows, n_slots, n_changed, kind) of each text and item with enough windows in common.

    kind: exact (all slots as in the item), parameters (other values, consistently) or
    inconsistent (not a copy: the item is not counted as leaked). Slots are places of the
    item: none may have two values, and no value of the item may be kept in one slot and
    replaced in another. The kind is that of the whole document unless inconsistent, else
    that of the best occurrence with enough windows: a run of windows near each other, or
    those at one distance from their places in the item. So several versions don't hide
    each other.
    """
    d = docs.where(F.col(text_col).isNotNull()).select(F.md5(F.col(text_col).cast("binary")).alias("digest"), F.col(text_col).alias("text"))
    items = written(benchmark_windows(benchmark), "benchmark")
    hits = _hits(d, items)
    # Words are cut out again only of texts that have hits.
    of_text = written(hits.groupBy("digest").agg(F.collect_list(F.struct("pos", "width", "h")).alias("ws")), "hits-of-texts")
    texts = d.join(hinted(of_text.select("digest"), BROADCAST_WINDOWS), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    words = texts.join(of_text.hint("merge"), "digest").select("digest", "ws", _both(F.col("text")).alias("x"))
    cut = F.transform("ws", lambda w: F.struct(w.pos.alias("pos"), w.h.alias("h"), F.slice("x.t", w.pos + 1, w.width).alias("doc_t"), F.slice("x.r", w.pos + 1, w.width).alias("doc_r")))
    found = words.select("digest", F.explode(cut).alias("w")).select("digest", "w.*").join(hinted(items, BROADCAST_WINDOWS), "h")
    found = found.where(F.when(F.col("raw"), F.col("doc_r") == F.col("r")).otherwise(F.col("doc_t") == F.col("t")))
    at_slots = F.transform("t", lambda t, i: F.when(t.isin(NUMBER, NAME, UNIT, NUMBER + UNIT), F.struct((F.col("at") + i).alias("p"), F.get("r", i).alias("a"), F.get("doc_r", i).alias("b"))))
    key = ["digest", "item_id", "n_windows"]
    pairs = found.select(*key, "h", "pos", "at", "least", F.filter(at_slots, lambda x: x.isNotNull()).alias("pairs"))
    order = Window.partitionBy(*key).orderBy("pos")
    apart = F.col("pos") - F.lag("pos").over(order) > RUN_GAP
    runs = pairs.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("long")).withColumn("run", F.sum("apart").over(order))
    whole, run, line = (F.struct(F.lit(n).alias("of"), c.cast("long").alias("id")) for n, c in enumerate([F.lit(0), F.col("run"), F.col("pos") - F.col("at")]))
    parts = runs.withColumn("part", F.explode(F.when(F.col("least"), F.array(whole, run, line)).otherwise(F.array(line))))
    # An item's windows bound each group; copies of a text add nothing to its sets.
    by_part = parts.groupBy(*key, "part").agg(F.collect_set("h").alias("hs"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("slots"))
    values = lambda same: F.array_distinct(F.transform(F.filter("slots", lambda x: (x["a"] == x["b"]) == F.lit(same)), lambda x: x["a"]))
    places = F.size(F.array_distinct(F.transform("slots", lambda x: x["p"])))
    out = by_part.select(
        *key, "part", F.size("hs").cast("long").alias("n_matched"), F.size("slots").cast("long").alias("n_slots"),
        F.size(F.filter("slots", lambda x: x["a"] != x["b"])).cast("long").alias("n_changed"),
        ((places == F.size("slots")) & ~F.arrays_overlap(values(True), values(False))).alias("consistent"),
    )
    rank = F.when(F.col("n_changed") == 0, 0).when(F.col("consistent"), 1).otherwise(2)
    enough = out.where(F.col("n_matched") >= MIN_COVERAGE * F.col("n_windows")).withColumn("rank", rank)
    told = F.struct((F.col("rank") == 2).alias("worse"), (F.col("part.of") > 0).alias("part"), "rank", (-F.col("n_matched")).alias("less"), "n_matched", "n_slots", "n_changed")
    best = enough.groupBy(*key).agg(F.min(told).alias("m"))
    kind = F.when(F.col("m.rank") == 0, "exact").when(F.col("m.rank") == 1, "parameters").otherwise("inconsistent")
    return best.select("digest", "item_id", "m.n_matched", "n_windows", "m.n_slots", "m.n_changed", kind.alias("kind"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row and benchmark item that leaked into it, with counts and kind.

    Null and empty texts and items match nothing. Equal rows all get their rows; a null id is
    kept. An item of fewer than MIN_PLAIN words can't be found.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"))
    found = written(contaminated_texts(docs, benchmark, text_col), "leaks")
    return d.join(found.hint("merge"), "digest").drop("digest")


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that a benchmark item leaked into."""
    found = written(contaminated_texts(docs, benchmark, text_col).where("kind <> 'inconsistent'").select(F.col("digest").alias("__digest")).distinct(), "leaks")
    return docs.withColumn("__digest", F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).join(found.hint("merge"), "__digest", "left_anti").drop("__digest")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).where("kind <> 'inconsistent'")
