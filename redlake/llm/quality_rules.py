"""Line-first cleaning by rules.

Each line is judged by itself; lines that fail are removed; a document that loses too
much of its text that way, or fails the base rules on the whole text, is rejected.
Everything is one projection over the scan: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, GAP_CHARS, bind, spaced, spaced_words, split_words, table, without

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected if its removed lines hold more than this share of its word characters.
MAX_LOST_PERCENT = 30
#: A line this long may lack a final mark: it is a wrapped paragraph, not a label.
FREE_WORDS = 10
#: A phrase makes a line boilerplate if the line is at most so many times as long: a paragraph may mention what it likes.
PHRASE_REACH = 10

# Fixed values.
HAS_WORD = r"[^\x20\x09-\x0D]"
FINAL_MARKS = tuple(".!?:;…。！？\"'”’»)]")
SYMBOL = r"[#$%&*<>|]"
SYMBOLS = "#*$%&|<>"
#: Marks in a row, and capitals in a row, that make a line worth counting.
RULE = r"[^\p{L}\p{N}\x20\x09-\x0D]{4}"
CAPITALS = r"\p{Lu}{4}"
SHOUT = "!! "
SEPARATORS = ("|", "»", "·", "›")
LINKS = ("http://", "https://", "www.")
MENU_LINES = (
    "home", "menu", "next", "previous", "share", "login", "log in", "sign in", "sign up", "read more", "back to top", "skip to content",
    "accueil", "suivant", "précédent", "partager", "connexion", "s'inscrire", "lire la suite", "haut de page",
    "startseite", "menü", "weiter", "zurück", "teilen", "anmelden", "registrieren", "mehr lesen", "nach oben",
    "inicio", "menú", "siguiente", "anterior", "compartir", "iniciar sesión", "registrarse", "leer más", "volver arriba",
)
BOILERPLATE = (
    "lorem ipsum", "enable javascript", "cookie policy", "use of cookies", "uses cookies", "privacy policy", "terms of use", "terms of service",
    "all rights reserved", "subscribe to our newsletter", "click here", "copyright ©", "copyright (c)",
    "activer javascript", "utilise des cookies", "politique de confidentialité", "conditions d'utilisation", "tous droits réservés", "abonnez-vous à notre", "cliquez ici",
    "javascript aktivieren", "verwendet cookies", "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "newsletter abonnieren", "hier klicken",
    "activar javascript", "utiliza cookies", "política de privacidad", "condiciones de uso", "todos los derechos reservados", "suscríbete a nuestro", "haz clic aquí",
)


def _count(text: Column, piece: str) -> Column:
    """Places of a piece that can't overlap itself."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def _word_chars(text: Column) -> Column:
    return F.length(without(text, GAP_CHARS))


def _kept(line: Column, pattern: str) -> Column:
    """Characters of a line that a class has."""
    return F.length(F.regexp_replace(line, f"[^{pattern}]+", ""))


def failed_rule(line: Column) -> Column:
    """The first rule that a line fails, or null. A line without a word fails none.

    punctuation: too many symbols a word; marks that outnumber letters and digits; shouting;
    few words without a final mark. navigation: separators, a menu's words, links for a third
    of the words. boilerplate: a phrase that makes up enough of the line; mostly capitals.
    Cheap searches come first; what costs more is counted only where a search found something.
    """
    n_words = F.size(split_words(line))
    symbols = F.length(line) - F.length(without(line, SYMBOLS))
    last = F.substring(F.rtrim(line, F.lit(GAP_CHARS)), -1, 1)
    navigation, links = F.lit(False), F.lit(0)
    for c in SEPARATORS:
        navigation |= F.contains(line, F.lit(c)) & (_count(line, c) >= 3)
    for c in LINKS:
        links = links + F.when(F.contains(line, F.lit(c)), _count(line, c)).otherwise(0)
    menu = (F.length(line) < 24) & F.lower(F.btrim(line, F.lit(GAP_CHARS))).isin(*MENU_LINES)
    linked = (F.contains(line, F.lit("http")) | F.contains(line, F.lit("www."))) & (3 * links >= n_words)
    marks = line.rlike(RULE) & (2 * _kept(line, r"\p{L}\p{N}") < F.length(without(line, GAP_CHARS)))
    capitals = line.rlike(CAPITALS) & (n_words > 1) & (10 * _kept(line, r"\p{Lu}") > 7 * _kept(line, r"\p{L}"))

    def boilerplate(low: Column) -> Column:
        found = F.lit(False)
        for phrase in BOILERPLATE:
            found |= F.contains(low, F.lit(phrase)) & (F.length(low) <= PHRASE_REACH * len(phrase))
        return found

    longest = PHRASE_REACH * max(map(len, BOILERPLATE))
    return (
        F.when(line.rlike(SYMBOL) & (10 * symbols > 3 * n_words), F.when(line.rlike(HAS_WORD), F.lit("punctuation")))
        .when(marks, F.lit("punctuation"))
        .when(F.contains(line, F.lit(SHOUT)) & (2 * _count(line, SHOUT) > n_words), F.lit("punctuation"))
        .when(navigation | menu | linked, F.lit("navigation"))
        .when((F.length(line) <= longest) & bind(F.lower(line), boilerplate), F.lit("boilerplate"))
        .when(capitals, F.lit("boilerplate"))
        .when(~last.isin(*FINAL_MARKS) & line.rlike(HAS_WORD) & (n_words < FREE_WORDS), F.lit("punctuation"))
    )


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Most texts have only different windows, and so only different hashes, or nearly so.
    Else a sort of numbers, 33 bits of a window's hash with its place, finds the few windows
    that may repeat; those are sorted themselves, so that equal neighbours are repeats.
    The places of repeats, in order, cover three words each less what they share with
    the one before.
    """

    def neighbours(s: Column, same, place) -> Column:
        n = F.size(s) - 1
        pairs = F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, F.lit(2), n), lambda a, b: F.when(same(a, b), F.array(place(a), place(b))))
        return F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))

    def maybe(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(w[i - 1], w[i], w[i + 1]))
        return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), sort(h)).otherwise(F.array().cast("array<int>")))

    def sort(h: Column) -> Column:
        coded = F.transform(
h, lambda x, i: F.shiftleft(x, 31).bitwiseOR((i + 1).cast("long")))
        return bind(F.sort_array(coded), lambda s: neighbours(s, lambda a, b: F.shiftright(a, 31) == F.shiftright(b, 31), lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")))

    def repeats(w: Column, places: Column) -> Column:
        windows = F.transform(places, lambda i: F.struct(F.concat_ws(" ", w[i - 1], w[i], w[i + 1]).alias("g"), i.alias("i")))
        return bind(F.sort_array(windows), lambda s: neighbours(s, lambda a, b: a.g == b.g, lambda x: x.i))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-2).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(F.sort_array(places), start, lambda a, p: F.struct(p.alias("at"), (a.n + F.least(F.lit(3), p - a.at)).alias("n")), lambda a: a.n)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bind(maybe(words), lambda m: F.when(F.size(m) == 0, F.lit(0)).otherwise(covered(repeats(words, m)))))


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts, verdicts and `clean_text`, the text without failed lines.

    A null text has no words, no lines and `clean_text` null; an empty text likewise with
    `clean_text` empty: both fail the base rule on length. Equal rows get equal results;
    other columns are not read.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    judged = F.transform(lines, lambda x: F.struct(x.alias("line"), failed_rule(x).alias("rule")))

    def counts(line: Column) -> Column:
        chars = F.length(F.replace(line, F.lit(" "), F.lit(""))).cast("long").alias("word_chars")
        return bind(spaced_words(line), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"), chars))

    base = d.select(
        "doc_id",
        "text",
        bind(spaced(text), counts).alias("w"),
        F.when(text.rlike(SYMBOL), F.length(text) - F.length(without(text, SYMBOLS))).otherwise(0).cast("long").alias("n_symbols"),
        bind(F.filter(lines, lambda x: x.rlike(HAS_WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        bind(
            judged,
            lambda j: F.struct(
                F.size(F.filter(j, lambda x: x.line.rlike(HAS_WORD))).cast("long").alias("n_lines"),
                F.transform(F.filter(j, lambda x: x.rule.isNotNull()), lambda x: x.rule).alias("rules"),
                F.array_join(F.transform(F.filter(j, lambda x: x.rule.isNull()), lambda x: x.line), "\n").alias("clean"),
            ),
        ).alias("l"),
    )
    n = lambda rule: F.size(F.filter(F.col("l.rules"), lambda r: r == rule)).cast("long")
    out = base.select(
        "doc_id", F.col("w.n_words").alias("n_words"), F.col("w.word_chars").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("w.n_repeat_words").alias("n_repeat_words"),
        F.col("l.n_lines").alias("n_lines"), n("punctuation").alias("n_punctuation"), n("navigation").alias("n_navigation"), n("boilerplate").alias("n_boilerplate"),
        F.when(F.size("l.rules") == 0, 0).otherwise(F.col("w.word_chars") - _word_chars(F.col("l.clean"))).cast("long").alias("lost_chars"),
        F.when(F.col("text").isNotNull(), F.col("l.clean")).alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = ~failed & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("word_chars"))
    return out.withColumn("base_failed", failed).withColumn("kept", kept)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_punctuation", "n_navigation", "n_boilerplate", "lost_chars")


NOT_SYMBOL = r"[^#*$%&|<>]+"
OUTER_GAP = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, {_sql(GAP)}), lambda x: x <> '') AS ws FROM t),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
c AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM c) GROUP BY rid),
l AS (SELECT rid, line, lower(line) AS low, len(list_filter(regexp_split_to_array(line, {_sql(GAP)}), lambda x: x <> '')) AS k, length(regexp_replace(line, {_sql(NOT_SYMBOL)}, '', 'g')) AS s
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t)),
j AS (SELECT rid, line, CASE WHEN k = 0 THEN NULL
    WHEN 10 * s > 3 * k OR (regexp_matches(line, {_sql(RULE)}) AND 2 * length(regexp_replace(line, {_sql(r"[^\p{L}\p{N}]+")}, '', 'g')) < length(regexp_replace(line, {_sql(GAP)}, '', 'g'))) OR 2 * len(regexp_extract_all(line, {_sql(SHOUT)})) > k THEN 'punctuation'
    WHEN {" OR ".join(f"len(string_split(line, {_sql(c)})) > 3" for c in SEPARATORS)} OR regexp_replace(low, {_sql(OUTER_GAP)}, '', 'g') IN ({", ".join(map(_sql, MENU_LINES))})
      OR (regexp_matches(line, 'http|www[.]') AND 3 * ({" + ".join(f"len(string_split(line, {_sql(c)})) - 1" for c in LINKS)}) >= k) THEN 'navigation'
    WHEN {" OR ".join(f"(contains(low, {_sql(x)}) AND length(low) <= {PHRASE_REACH * len(x)})" for x in BOILERPLATE)} THEN 'boilerplate'
    WHEN k > 1 AND regexp_matches(line, {_sql(CAPITALS)}) AND 10 * length(regexp_replace(line, {_sql(r"[^\p{Lu}]+")}, '', 'g')) > 7 * length(regexp_replace(line, {_sql(r"[^\p{L}]+")}, '', 'g')) THEN 'boilerplate'
    WHEN right(regexp_replace(line, {_sql(OUTER_GAP)}, '', 'g'), 1) NOT IN ({', '.join(map(_sql, FINAL_MARKS))}) AND k < {FREE_WORDS} THEN 'punctuation' END AS rule, k FROM l),
a AS (SELECT rid, count(*) FILTER (k > 0) AS n_lines, count(DISTINCT line) FILTER (k > 0) AS n_distinct, count(*) FILTER (rule = 'punctuation') AS n_punctuation,
    count(*) FILTER (rule = 'navigation') AS n_navigation, count(*) FILTER (rule = 'boilerplate') AS n_boilerplate,
    coalesce(sum(length(regexp_replace(line, {_sql(GAP)}, '', 'g'))) FILTER (rule IS NOT NULL), 0)::BIGINT AS lost_chars FROM j GROUP BY rid),
o AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, {_sql(GAP)}, '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, {_sql(NOT_SYMBOL)}, '', 'g'))::BIGINT AS n_symbols,
    n_lines - n_distinct AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, n_lines, n_punctuation, n_navigation, n_boilerplate, lost_chars
  FROM w JOIN a USING (rid) LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AS kept,
  n_lines, n_punctuation, n_navigation, n_boilerplate, lost_chars
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM o)
"""
