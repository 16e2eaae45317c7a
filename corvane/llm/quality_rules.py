"""Line-first cleaning, and the counts by which whole documents fail.

Every line is tried against rules of punctuation, navigation and boilerplate;
failing lines go, and a document that loses too much of its words with them is
rejected. Before that a document fails outright when it is very short or when
much of it lies in repeated 8-word windows. Everything is a map over rows:
column expressions only, and no shuffle.

Defined results. NULL text reads as empty: no words, failed. Blank lines are
kept as they are and count for nothing. Rows are judged one by one, so repeated
rows get the same result; an empty table gives no rows. The document's columns
come back as one struct ``doc``, so that any names are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm.common import BREAKS, count_words, split_words
from corvane.operators.once import once

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

# Line rules.
SYMBOL_SHARE = 0.3  # symbols or bars per word
LOUD_SHARE = 0.3  # runs of exclamation and question marks per word
FEWEST_DIFFERENT = 0.25  # different words per word of a line
LONG_LINE = 12  # words from which a line can be monotonous
SHORT_LINE = 4  # words up to which a line without an end mark is a menu entry
BOILERPLATE_WORDS = 25  # a longer line is prose, whatever it mentions
# Stock phrases of pages in English, German, French and Spanish.
BOILERPLATE = (
    "accept all cookies",
    "we use cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "all rights reserved",
    "click here",
    "read more",
    "sign up for",
    "subscribe to our",
    "log in to",
    "enable javascript",
    "skip to content",
    "lorem ipsum",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "hier klicken",
    "mehr erfahren",
    "zum inhalt springen",
    "tous droits réservés",
    "accepter les cookies",
    "politique de confidentialité",
    "mentions légales",
    "cliquez ici",
    "lire la suite",
    "aller au contenu",
    "todos los derechos reservados",
    "aceptar cookies",
    "política de privacidad",
    "términos de uso",
    "haga clic aquí",
    "leer más",
    "saltar al contenido",
)
MARKED = r"[#*$%&|<>»›•·]|[!?]{2}"  # what a line of symbols, bars or shouting has somewhere
END_MARK = r"[.!?:;…。！？\"'”’»)\]]\s*$"
LEAST_KEPT = 0.5  # of a document's words


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc`` (all columns), ``words, lines`` and the counts of the whole text."""
    body = F.coalesce(F.col(text), F.lit(""))
    parts = docs.select(F.struct(*docs.columns).alias("doc"), body.alias("body"))
    parts = once(parts, words=split_words(F.col("body")), lines=F.split("body", "\n"))
    parts = once(
        parts,
        windows=F.when(
            F.size("words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)),
                lambda i: F.xxhash64(F.slice("words", i, WINDOW)),
            ),
        ),
        full_lines=F.filter("lines", lambda x: x.rlike(f"[^{BREAKS}]")),
    )
    # Only a text with a window found twice goes on to the places of its windows.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    parts = once(
        parts.withColumn("repeats", F.coalesce(repeats, F.lit(False))),
        placed=F.when(
            F.col("repeats"),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("windows")
    twin = lambda p, j: (F.get("placed", j - 1)["h"] == p["h"]) | (F.get("placed", j + 1)["h"] == p["h"])
    found = F.filter("placed", lambda p, j: F.coalesce(twin(p, j), F.lit(False)))
    parts = once(parts, starts=F.array_sort(F.transform(found, lambda p: p["i"]))).drop("placed")
    covered = F.aggregate(
        F.transform(
            "starts",
            lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - p, F.lit(WINDOW))),
        ),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    return parts.select(
        "doc",
        "body",
        "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < LEAST_WORDS)
        | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")),
    )


def line_fails(line: Column, words: Column) -> Column:
    """Whether one line of so many words is symbols, shouting, navigation, monotony or boilerplate.

    The dearer a condition, the later it comes and the fewer lines reach it.
    """
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    bars = F.regexp_count(line, F.lit(r"[|»›•·]"))
    loud = F.regexp_count(line, F.lit(r"[!?]{2,}"))
    different = F.size(F.array_distinct(split_words(line)))
    marked = line.rlike(MARKED) & (
        (symbols > SYMBOL_SHARE * words) | (bars > SYMBOL_SHARE * words) | (loud > LOUD_SHARE * words)
    )
    return (words > 0) & (
        ((words <= SHORT_LINE) & ~line.rlike(END_MARK))
        | marked
        | ((words <= BOILERPLATE_WORDS) & line.rlike("(?iu)" + "|".join(BOILERPLATE)))
        | ((words >= LONG_LINE) & (different < FEWEST_DIFFERENT * words))
    )


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every document with its counts, ``cleaned`` text and whether it is ``kept``."""
    counted = base_counts(docs, text)
    # Lambdas work an expression out at each place that names it, so the words are counted first.
    sized = F.transform("lines", lambda x: F.struct(x.alias("line"), count_words(x).alias("words")))
    counted = once(counted, sized=sized)
    counted = once(counted, good=F.filter("sized", lambda x: ~line_fails(x["line"], x["words"])))
    left = F.aggregate("good", F.lit(0).cast("long"), lambda total, x: total + x["words"])
    counted = once(counted, kept_words=left)
    return counted.select(
        "doc",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept_words",
        (~F.col("base_failed") & (F.col("kept_words") >= LEAST_KEPT * F.col("n_words"))).alias("kept"),
        F.array_join("good.line", "\n").alias("cleaned"),
    )
