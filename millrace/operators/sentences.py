"""Sentence splitting by a model of the corpus itself: abbreviations and sentence starters from counts of its words.

A word form is an abbreviation when it nearly always carries a period: the likelihood ratio of "always a period" against the corpus'
own share of periods, weighed by shortness, inner periods and the times it stands without one (Kiss and Strunk, 2006). A form is a
sentence starter when it follows the period of another word far more often than its frequency explains (likelihood ratio of the
two-by-two table). Both come from one aggregate over (form, form before its sentence gap), so a corpus is read once.

A period of an abbreviation ends a sentence only before an upper-case word that is a starter, or that the corpus also writes in
lower case and never in upper case inside a sentence. Every other rule break stays.

Only words at candidate breaks meet the model, and only positions come back to the texts, so a text moves once.

Defined results: a null or empty text has no sentences and adds no counts; repeated rows count as often as they occur; keys of
``model_sentences`` must be unique (a null key is one key); an empty table has an empty model and no sentences; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ColumnOrName, col, let
from ..session import cut_lineage

# The published thresholds and the share of periods that an abbreviation is expected to have.
ABBREVIATION_SCORE = 0.3
STARTER_SCORE = 30.0
PERIOD_SHARE = 0.99

GAPS = r" \t\n\r\f"
# What does not belong to a word: everything before its first letter or digit, and behind its last one but periods.
AROUND = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}\p{M}.]+$"
ENDED = r"[.!?][^\p{L}\p{N}]*$"
BREAK = rf"(?<=[.!?])(?=[{GAPS}])"


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, AROUND, "")


def _form(bare: Column) -> Column:
    """Lower-case form without its period; null where it has no letter or goes on with periods."""
    form = F.lower(F.regexp_replace(bare, r"\.$", ""))
    return F.when(form.rlike(r"\p{L}") & ~form.endswith("."), form)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{GAPS}]+"), lambda w: w != "")


def _word_pairs(df: DataFrame, text: ColumnOrName) -> DataFrame:
    """(word, before, n): how often each word stands behind each other one that holds a full stop, an exclamation or a question mark;
    ``before`` is empty behind all others and null at the start of a text."""

    def with_previous(words):
        def of(w, i):
            before = F.get(words, i - 1)
            marked = before.contains(".") | before.contains("!") | before.contains("?")
            return F.struct(w.alias("word"), F.when(i > 0, F.when(marked, before).otherwise("")).alias("before"))

        return F.transform(words, of)

    rows = df.select(F.explode(let(_words(col(text).cast("string")), with_previous)).alias("w")).select("w.*")
    return rows.groupBy("word", "before").agg(F.count(F.lit(1)).alias("n"))


def _form_pairs(words: DataFrame) -> DataFrame:
    """(form, behind, n, period, lower, upper_inside) of ``_word_pairs``: what a word is follows from itself and the one before it,
    so it is looked into once, however often it occurs."""
    bare = words.select("n", "before", _bare(F.col("word")).alias("b"), _bare(F.col("before")).alias("bb"))
    ended = F.coalesce(F.col("before").rlike(ENDED), F.lit(True))
    facts = bare.select(
        "n", _form(F.col("b")).alias("form"), F.when(F.col("bb").endswith("."), _form(F.col("bb"))).alias("behind"),
        F.col("b").endswith(".").alias("period"), F.col("b").rlike(r"^\p{Ll}").alias("lower"),
        (F.col("b").rlike(r"^\p{Lu}") & ~ended).alias("upper_inside"),
    )
    return facts.filter("form is not null").groupBy("form", "behind").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("period", "lower", "upper_inside")]
    )


def sentence_model(df: DataFrame, text: ColumnOrName) -> DataFrame:
    """(form, with_period, without_period, lower, upper_inside, starts, abbreviation_score, abbreviation, starter_score, starter)."""
    pairs = cut_lineage(_form_pairs(_word_pairs(df, text)))
    forms = pairs.groupBy("form").agg(*[F.sum(c).alias(c) for c in ("n", "period", "lower", "upper_inside")])
    total = forms.agg(F.sum("n").cast("double")).scalar()
    share = forms.agg(F.sum("period") / F.sum("n")).scalar()
    bare = F.col("n") - F.col("period")
    letters = F.length(F.replace("form", F.lit("."), F.lit("")))
    periods = F.length("form") - letters + 1

    def likelihood(p: Column) -> Column:
        return F.col("period") * F.ln(p) + F.when(bare > 0, bare * F.ln(1 - p)).otherwise(0.0)

    ratio = 2 * (likelihood(F.lit(PERIOD_SHARE)) - likelihood(share))
    score = F.when(F.col("period") > 0, ratio * periods * F.exp(-letters - bare * F.ln(letters))).otherwise(0.0)
    scored = forms.withColumn("abbreviation_score", score).withColumn("abbreviation", F.col("abbreviation_score") >= ABBREVIATION_SCORE)
    scored = cut_lineage(scored.withColumn("total", total))

    abbreviations = scored.filter("abbreviation").select(F.col("form").alias("behind"))
    starts = pairs.filter("behind is not null").join(abbreviations, "behind", "left_anti").groupBy("form").agg(F.sum("n").alias("starts"))
    ends = F.coalesce(scored.filter("not abbreviation").agg(F.sum("period").cast("double")).scalar(), F.lit(0.0))
    both = F.col("starts")
    table = [  # (observed, row sum, column sum) of word or not, behind an end or not
        (both, ends, F.col("n")),
        (ends - both, ends, F.col("total") - F.col("n")),
        (F.col("n") - both, F.col("total") - ends, F.col("n")),
        (F.col("total") - ends - F.col("n") + both, F.col("total") - ends, F.col("total") - F.col("n")),
    ]
    parts = [F.when(seen > 0, seen * F.ln(seen * F.col("total") / (row * column))).otherwise(0.0) for seen, row, column in table]
    above = both * F.col("total") > ends * F.col("n")
    joined = scored.join(starts, "form", "left").withColumn("starts", F.coalesce("starts", F.lit(0)))
    starter_score = F.when(above, 2 * (parts[0] + parts[1] + parts[2] + parts[3])).otherwise(0.0)
    return joined.withColumn("starter_score", starter_score).select(
        "form", F.col("period").alias("with_period"), bare.alias("without_period"), "lower", "upper_inside", "starts",
        "abbreviation_score", "abbreviation", "starter_score", (F.col("starter_score") >= STARTER_SCORE).alias("starter"),
    )


def _pieces(text: ColumnOrName) -> Column:
    """The text cut before every gap behind ``.``, ``!`` or ``?``; gaps stay at the front of the next piece."""
    return F.split(F.coalesce(col(text).cast("string"), F.lit("")), BREAK, -1)


def _held_back(df: DataFrame, key: str, text: str, model: DataFrame) -> DataFrame:
    """(key, held): for each row with any, the sorted positions of pieces that do not end their sentence."""

    def last_and_next(words):
        def of(word, i):
            ends = word.endswith(".") | word.endswith("!") | word.endswith("?")
            return F.when(ends, F.struct(word.alias("last"), F.get(words, i + 1).alias("next")))

        # The n-th word that ends like this ends the n-th piece.
        return F.filter(F.transform(words, of), lambda b: b.isNotNull())

    ends = df.select(key, F.posexplode(let(_words(col(text).cast("string")), last_and_next)).alias("at", "b")).select(key, "at", "b.*")
    # Behind the last word nothing is to be decided.
    dotted = ends.filter(F.col("next").isNotNull() & F.col("last").contains(".")).select(key, "at", "next", _bare(F.col("last")).alias("bare"))
    breaks = dotted.filter(F.col("bare").endswith(".")).select(key, "at", "next", _form(F.col("bare")).alias("form"))
    abbreviations = model.filter("abbreviation").select("form")
    openers = model.filter("starter or (lower > 0 and upper_inside = 0)").select(F.col("form").alias("next"), F.lit(True).alias("opens"))
    followed = breaks.join(abbreviations, "form").select(key, "at", _bare(F.col("next")).alias("bare"))
    followed = followed.select(key, "at", _form(F.col("bare")).alias("next"), F.col("bare").rlike(r"^\p{Lu}").alias("upper"))
    undecided = followed.join(openers, "next", "left")
    held = undecided.filter(~(F.col("upper") & F.coalesce("opens", F.lit(False))))
    return held.groupBy(key).agg(F.sort_array(F.collect_list("at")).alias("held"))


def model_sentences(df: DataFrame, key: str, text: str, model: DataFrame) -> DataFrame:
    """(key, sentences) of every row of ``df``; ``model`` is the result of ``sentence_model``."""
    held = _held_back(df, key, text, model).withColumnRenamed(key, "__key")
    none = F.array().cast("array<int>")

    def glued(b):
        pieces, held_back = b["pieces"], b["held"]

        def of(ends):
            def sentence(end, i):
                start = F.coalesce(F.get(ends, i - 1), F.lit(-1)) + 1
                return F.regexp_replace(F.array_join(F.slice(pieces, start + 1, end - start + 1), ""), rf"^[{GAPS}]+|[{GAPS}]+$", "")

            return F.filter(F.transform(ends, sentence), lambda s: s != "")

        return let(F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), held_back), of)

    joined = df.select(key, text).join(held, F.col(key).eqNullSafe(F.col("__key")), "left")
    bound = F.struct(_pieces(text).alias("pieces"), F.coalesce("held", none).alias("held"))
    return joined.select(key, let(bound, glued).alias("sentences"))
