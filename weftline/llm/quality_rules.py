"""Line-first cleaning: every rule judges one line; lines that fail go, and a document that loses too much goes with them.

DataFrame functions only. A row's whole text is handled inside the row: nothing is shuffled, so no key can be hot.

Defined results: a null or empty text has no words and fails the base rules; lines without a word are neither kept nor
counted; of equal lines in one document only the first can be kept; equal rows get equal verdicts; an empty table gives an
empty table. Columns other than the text are carried unread; own columns start with `_q_`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """A line fails if it has no sentence mark (scripts without one pass); more than `symbol_share` marks a word; separators of a menu or table; a phrase of site boilerplate, if it has `phrase_words` words or fewer, so that prose may speak of these things; or if it repeats an earlier line."""

    sentence: str = r"[.!?…؟۔।॥։][\"'”’»)\]]*([ \t-\r]|$)|[。！？｡។။།።ก-๛ກ-ໝ]"
    marks: str = "#*$%&|<>{}"
    shout: str = "!!"
    symbol_share: float = 0.3
    separators: str = "|»›"
    separator_count: int = 3
    phrases: str = (
        r"(?i)(cookies? (policy|settings|notice)|accept (all )?cookies|enable javascript|javascript (is|must be)|terms (of (use|service)|and conditions)|privacy policy|all rights reserved|lorem ipsum|sign in|log ?in|subscribe (to|now)|click here|read more|share (this|on)|skip to (main )?content|back to top|powered by"
        r"|cookie-(richtlinie|einstellungen)|cookies (akzeptieren|accepter|aceptar)|datenschutzerklärung|alle rechte vorbehalten|nutzungsbedingungen|jetzt anmelden|hier klicken|weiterlesen|nach oben|zum inhalt springen"
        r"|politique de confidentialité|tous droits réservés|conditions (générales|d'utilisation)|se connecter|cliquez ici|lire la suite|haut de page|aller au contenu"
        r"|política de (privacidad|cookies)|todos los derechos reservados|términos (de uso|y condiciones)|iniciar sesión|haz clic aquí|leer más|seguir leyendo|ir al contenido)"
    )
    phrase_words: int = 15
    least_kept: float = 0.5


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def count_of(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of `width` words whose sequence occurs twice or more in the row. Windows are compared by 64-bit hashes, first as a set, and sorted only where two are equal."""

    def grams(w: Column) -> Column:
        index = F.sequence(F.lit(0), F.size(w) - width)
        return F.when(F.size(w) < width, F.array().cast("array<bigint>")).otherwise(F.transform(index, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])))

    def covered(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            again = lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(again(x, k), (x["h"] == F.get(s, k + 1)["h"]), (x["h"] == F.get(s, k - 1)["h"]), F.lit(False))), lambda x: x["i"]))

        def total(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)

        return let(ordered, lambda s: let(positions(s), total))

    return let(words, lambda w: let(grams(w), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g))))


def line_fails(line: Column, n: Column, rules: LineRules) -> Column:
    shouts = (F.char_length(line) - F.char_length(F.replace(line, F.lit(rules.shout), F.lit("")))) / len(rules.shout)
    noisy = count_of(line, rules.marks) + shouts > n * F.lit(rules.symbol_share)
    menu = count_of(line, rules.separators) >= F.greatest(F.lit(rules.separator_count).cast("double"), n / 4)
    return ~line.rlike(rules.sentence) | noisy | menu | ((n <= rules.phrase_words) & line.rlike(rules.phrases))


def judge(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """docs with the struct `_q_`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_words_kept, n_lines_failed, kept, clean_text."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    judged = F.transform(
        F.array_distinct(F.col("_q_lines")),
        lambda x: let(F.size(words_of(x)).cast("long"), lambda n: F.struct(x.alias("line"), n.alias("n"), line_fails(x, n, rules).alias("bad"))),
    )
    good = F.filter(F.col("_q_judged"), lambda x: ~x["bad"])
    stage = docs.withColumns({"_q_text": t}).withColumns({"_q_lines": lines, "_q_words": words_of(F.col("_q_text"))})
    stage = stage.withColumns({"_q_judged": judged, "_q_n": F.size("_q_words").cast("long"), "_q_repeat": repeated_words(F.col("_q_words"))})
    stage = stage.withColumns({"_q_good": good, "_q_dup": (F.size("_q_lines") - F.size("_q_judged")).cast("long")})
    kept_words = F.aggregate(F.col("_q_good"), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    base = (F.col("_q_n") < 10) | (100 * F.col("_q_repeat") > 20 * F.col("_q_n"))
    verdict = F.struct(
        F.col("_q_n").alias("n_words"),
        F.char_length(F.translate(F.col("_q_text"), SPACES, "")).cast("long").alias("word_chars"),
        count_of(F.col("_q_text"), SYMBOLS).alias("n_symbols"),
        F.col("_q_dup").alias("n_dup_lines"),
        F.col("_q_repeat").alias("n_repeat_words"),
        base.alias("base_failed"),
        kept_words.alias("n_words_kept"),
        (F.size("_q_judged") - F.size("_q_good")).cast("long").alias("n_lines_failed"),
        (~base & (kept_words >= F.lit(rules.least_kept) * F.col("_q_n"))).alias("kept"),
        F.array_join(F.transform(F.col("_q_good"), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    return stage.withColumn("_q_", verdict).drop("_q_text", "_q_lines", "_q_words", "_q_judged", "_q_n", "_q_repeat", "_q_good", "_q_dup")


def clean(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The documents that stay, with the lines that passed as their text; same columns as docs."""
    judged = judge(docs, text, rules)
    # as a generator's input the verdict is made once; a filter on it would make it a second time
    kept = judged.select(*[F.col(f"`{c}`").alias(f"_q_{i}") for i, c in enumerate(docs.columns)], F.explode(F.filter(F.array("_q_"), lambda v: v["kept"])).alias("_q_"))
    return kept.select(*[(F.col("_q_.clean_text") if c == text else F.char_length("_q_.clean_text").cast("long") if c == "n_chars" else F.col(f"_q_{i}")).alias(c) for i, c in enumerate(docs.columns)])
