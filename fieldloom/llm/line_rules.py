"""Line-first quality rules: judge each line, drop the failing ones, then judge what is left of the document.

Everything is a column expression over one row, so the operator is a narrow map: no shuffle, no Python.

Defined results: a null, empty or blank text has no words and fails the base rules; repeated rows are judged
each by itself; ties do not arise; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import BLANKS, count_words, free_name, let, table, words_of

#: Phrases of page furniture in English, French, German and Spanish, lower case.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "leave a comment",
    "log in to continue", "lorem ipsum", "privacy policy", "read more", "related articles", "share on facebook", "share this",
    "sign in to continue", "sign up", "skip to content", "skip to main content", "subscribe to our newsletter", "terms of service",
    "terms of use", "this site uses cookies", "view all posts", "we use cookies", "your browser does not support",
    "accepter les cookies", "aller au contenu", "articles similaires", "cliquez ici", "conditions d'utilisation", "conditions générales de vente",
    "en savoir plus", "haut de page", "laisser un commentaire", "lire la suite", "mentions légales", "nous utilisons des cookies",
    "partager sur facebook", "politique de confidentialité", "s'inscrire à la newsletter", "tous droits réservés",
    "alle cookies akzeptieren", "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "auf facebook teilen", "ähnliche beiträge", "datenschutzerklärung",
    "hier klicken", "jetzt registrieren", "kommentar hinterlassen", "mehr erfahren", "nach oben scrollen", "newsletter abonnieren",
    "nutzungsbedingungen", "weiterlesen", "wir verwenden cookies", "zum inhalt springen",
    "aceptar todas las cookies", "artículos relacionados", "aviso legal", "compartir en facebook", "deja un comentario", "haz clic aquí",
    "leer más", "política de cookies", "política de privacidad", "saltar al contenido", "suscríbete a nuestro boletín", "todos los derechos reservados",
    "términos de uso", "términos y condiciones", "utilizamos cookies", "volver arriba",
)
#: Marks that part the entries of a navigation line.
BARS = "|›·•→"
SYMBOLS = "#*$%&|<>"
#: Marks that may end a sentence.
ENDINGS = r"""[.!?…。！？:;"'”’)\]]$"""


@dataclass(frozen=True)
class LineRules:
    """Limits, all in whole numbers so that every engine decides alike."""

    furniture_chars: int = 100  # a longer line is prose, whatever phrase it holds
    short_line: int = 8  # a line with fewer words must end as a sentence does
    nav_bars: int = 2  # a line with more of BARS, and one for each nav_words words, is navigation
    nav_words: int = 6
    symbol_percent: int = 15  # of a line's non-blank characters
    upper_percent: int = 60  # of a line's Latin letters, from upper_least on
    upper_least: int = 8
    lost_percent: int = 40  # of a document's words
    window: int = 5
    min_words: int = 10
    repeat_percent: int = 20


def _repeat_words(words: Column, window: int) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text, the first occurrence included."""

    def counted(h: Column) -> Column:
        last = F.size(h) - window
        wins = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        return F.when(last < 0, F.lit(0)).otherwise(let(wins, covered))

    def covered(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)
        )

    def repeated(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["h"] == b["h"], F.lit(False))
        starts = F.sort_array(F.transform(F.filter(s, lambda e, k: same(k + 1, e) | ((k > 0) & same(k - 1, e))), lambda e: e["i"]))
        return let(starts, length)

    def length(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(F.transform(words, lambda w: F.xxhash64(w)), counted).cast("long")


def _any_of(phrases: tuple[str, ...]) -> str:
    """A pattern that finds any of the phrases, which are letters, blanks and apostrophes, between signs that are no letters a-z; only there
    are the alternatives tried, which are dealt by their first letter."""
    by: dict[str, list[str]] = {}
    for p in sorted(phrases):
        by.setdefault(p[0], []).append(p[1:])
    return "[^a-z](?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by.items()) + ")[^a-z]"


def _fails(line: Column, r: LineRules) -> Column:
    """Whether a line that has a word fails a rule. What several rules read is bound first: a lambda's body is evaluated as it is written."""

    def marked(marks: Column) -> Column:
        bars = F.length(line) - F.length(F.translate(line, BARS, ""))
        symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
        navigation = (bars > r.nav_bars) & (bars * r.nav_words > count_words(line))
        return (marks > 0) & ((symbols * 100 > F.length(F.translate(line, BLANKS, "")) * r.symbol_percent) | navigation)

    def shouting(upper: Column) -> Column:
        letters = F.regexp_count(line, F.lit("[A-Za-z]"))
        return (upper * 100 > r.upper_least * r.upper_percent) & let(letters, lambda n: (n >= r.upper_least) & (upper * 100 > n * r.upper_percent))

    dangling = ~F.rtrim(line, F.lit(BLANKS)).rlike(ENDINGS) & (count_words(line) < r.short_line)
    furniture = (F.length(line) <= r.furniture_chars) & F.concat(F.lit(" "), F.lower(line), F.lit(" ")).rlike(_any_of(BOILERPLATE))
    # cheap tests that most lines end at come first in each rule
    every = f"[{SYMBOLS}{BARS.replace('|', '')}]"
    return let(F.regexp_count(line, F.lit(every)), marked) | let(F.regexp_count(line, F.lit("[A-Z]")), shouting) | dangling | furniture


def judge(text: Column, rules: LineRules = LineRules()) -> Column:
    """A struct for a text: the base counts, ``n_lost_words``, ``base_failed``, ``kept`` and ``clean_text``.

    ``clean_text`` holds the lines that pass, in order, and blank lines; it is null for a null text.
    """
    r = rules

    def with_lines(lines: Column) -> Column:
        """lines: line, full (has a word) and bad of each line."""

        def counts(w: Column) -> Column:
            full = F.transform(F.filter(lines, lambda x: x["full"]), lambda x: x["line"])
            bad = F.filter(lines, lambda x: x["bad"])
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.translate(F.coalesce(text, F.lit("")), BLANKS, "")).cast("long").alias("word_chars"),
                (F.length(F.coalesce(text, F.lit(""))) - F.length(F.translate(F.coalesce(text, F.lit("")), SYMBOLS, ""))).cast("long").alias("n_symbols"),
                let(full, lambda f: (F.size(f) - F.size(F.array_distinct(f))).cast("long")).alias("n_dup_lines"),
                _repeat_words(w, r.window).alias("n_repeat_words"),
                let(
                    bad,
                    lambda b: F.struct(
                        F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + count_words(x["line"])).alias("lost"),
                        F.when(F.size(b) == 0, text).otherwise(F.array_join(F.transform(F.filter(lines, lambda x: ~x["bad"]), lambda x: x["line"]), "\n")).alias("clean"),
                    ),
                ).alias("lines"),
            )

        return let(words_of(text), counts)

    def told(line: Column) -> Column:
        full = F.trim(line, F.lit(BLANKS)) != ""
        return F.struct(line.alias("line"), full.alias("full"), (full & _fails(line, r)).alias("bad"))

    def verdict(c: Column) -> Column:
        failed = (c["n_words"] < r.min_words) | (c["n_repeat_words"] * 100 > c["n_words"] * r.repeat_percent)
        kept = ~failed & (c["lines"]["lost"] * 100 <= c["n_words"] * r.lost_percent)
        return F.struct(
            *[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            c["lines"]["lost"].alias("n_lost_words"),
            failed.alias("base_failed"),
            kept.alias("kept"),
            c["lines"]["clean"].alias("clean_text"),
        )

    return let(let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), told), with_lines), verdict)


def clean_documents(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The documents that stay, with their text cleaned; the columns are those of ``docs``."""
    # through an array, so that the verdict is computed once and not again for the filter
    good = F.filter(F.array(judge(docs[text], rules)), lambda q: q["kept"])
    judged = free_name("judged", docs)
    return docs.select("*", F.explode(good).alias(judged)).withColumn(text, F.col(f"{judged}.clean_text")).drop(judged)


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    q = docs.select("doc_id", judge(F.col("text")).alias("q"))
    return q.select("doc_id", *[F.col(f"q.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept")])


def _sql(r: LineRules = LineRules()) -> str:
    likes = "length(line) <= {} AND regexp_matches(' ' || lower(line) || ' ', '[^a-z]({})[^a-z]')".format(r.furniture_chars, "|".join(BOILERPLATE).replace("'", "''"))
    ends = ENDINGS.replace("'", "''")
    blank = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT uid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT uid, i, array_to_string(ws[i:i + {r.window - 1}], ' ') AS g FROM (SELECT uid, ws, unnest(range(1, len(ws) - {r.window - 2})) AS i FROM w WHERE len(ws) >= {r.window})),
dup AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT uid, CAST(sum(least({r.window}, coalesce(nx - i, {r.window}))) AS BIGINT) AS n FROM (SELECT uid, i, lead(i) OVER (PARTITION BY uid ORDER BY i) AS nx FROM dup) GROUP BY uid),
lines AS (SELECT uid, line FROM (SELECT uid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE trim(line, {blank}) <> ''),
lm AS (SELECT uid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') AS bare,
  length(regexp_replace(line, '[^A-Z]+', '', 'g')) AS up, length(regexp_replace(line, '[^A-Za-z]+', '', 'g')) AS al, length(regexp_replace(line, '[^{BARS}]+', '', 'g')) AS bars FROM lines),
lf AS (SELECT uid, line, n, ({likes}) OR (bars > {r.nav_bars} AND bars * {r.nav_words} > n) OR (length(regexp_replace(bare, '[^#*$%&|<>]+', '', 'g')) * 100 > length(bare) * {r.symbol_percent})
  OR (al >= {r.upper_least} AND up * 100 > al * {r.upper_percent}) OR (n < {r.short_line} AND NOT regexp_matches(rtrim(line, {blank}), '{ends}')) AS bad FROM lm),
la AS (SELECT uid, count(*) - count(DISTINCT line) AS dups, coalesce(sum(CASE WHEN bad THEN n END), 0) AS lost FROM lf GROUP BY uid),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words
  FROM w LEFT JOIN rep USING (uid) LEFT JOIN la USING (uid))
SELECT *, (n_words < {r.min_words} OR n_repeat_words * 100 > n_words * {r.repeat_percent}) AS base_failed,
  NOT (n_words < {r.min_words} OR n_repeat_words * 100 > n_words * {r.repeat_percent}) AND n_lost_words * 100 <= n_words * {r.lost_percent} AS kept FROM b"""


ORACLE = _sql()
