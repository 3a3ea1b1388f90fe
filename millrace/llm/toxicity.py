"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a lexicon (a short fixed list and words learned from training labels), how near
second-person words stand to it, capitals, punctuation, and obfuscation (symbols or digits inside words, spelled-out
repeats, lexicon words that show only after undoing that). The trees and the calibration are fitted on about
FIT_ROWS labelled training rows; labels are matched by doc_id, and neither they nor doc_id, source or lang are features.

Defined results: a null text is empty; an empty text is scored like any other; a document without a label takes part in
scoring only; of several labels for a doc_id the largest counts; without labels of both kinds every score is the share of
label 1 (0 without labels). An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seeded import seeded_unit
from .common import per_batch, stored, worker_cache

FIT_ROWS = 20_000
TREES, DEPTH = 30, 4
LEARNED_WORDS = 200
LEXICON = (
    "bastard bitch bullshit clown coward crap creep damn degenerate dumb dumbass disgusting filth filthy freak garbage "
    "hate idiot idiotic imbecile jerk kill liar loser lunatic moron moronic nasty pathetic pig psycho retard rotten scum "
    "scumbag shit shut sick slut stupid sucker thug trash troll ugly useless vermin whore worthless"
).split()
SECOND_PERSON = (
    "you your yours yourself yourselves u ur youre du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos "
    "usted ustedes ti tus vosotros"
).split()
FEATURES = (
    "log_words hits density distinct second_density proximity near_hits caps_words caps_letters exclamations punctuation "
    "symbols obfuscated hidden_hits stretched"
).split()

_HIT, _SECOND, _CAPS, _ODD, _HIDDEN, _STRETCHED = 1, 2, 4, 8, 16, 32
_PLAIN_EDGE = ".,;:!?\"'()[]{}-–—…«»“”‘’"
_UNDO = str.maketrans("013457@$!|", "oieastasil")
_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123))
_MEMO = 400_000


class _Codes(dict):
    """Flags of a token; ``words`` remembers which lexicon word it is."""

    def __init__(self, lexicon: frozenset[str]):
        super().__init__()
        self.lexicon = lexicon
        self.second = frozenset(SECOND_PERSON)

    def __missing__(self, token: str) -> int:
        if len(self) > _MEMO:
            self.clear()
        word = token.strip(_PLAIN_EDGE)
        low = word.lower()
        code = 0
        if low in self.lexicon:
            code |= _HIT
        if low in self.second:
            code |= _SECOND
        if len(word) > 1 and word.isupper():
            code |= _CAPS
        if word and not word.isalpha():
            if any(c.isalpha() for c in word):
                code |= _ODD
            if not code & _HIT:
                letters = "".join(c for c in low if c.isalpha())
                undone = "".join(c for c in low.translate(_UNDO) if c.isalpha())
                if letters in self.lexicon or undone in self.lexicon:
                    code |= _HIT | _HIDDEN
        if any(a == b == c for a, b, c in zip(word, word[1:], word[2:])):
            code |= _STRETCHED
        self[token] = code
        return code


def _features(text: str | None, codes: _Codes) -> list[float]:
    text = text or ""
    tokens = text.split()
    flags = np.fromiter(map(codes.__getitem__, tokens), dtype=np.uint8, count=len(tokens))
    raw = text.encode("utf-8", "surrogatepass")
    n, size = max(1, len(tokens)), max(1, len(raw))
    hits = np.flatnonzero(flags & _HIT)
    second = np.flatnonzero(flags & _SECOND)
    proximity = near = 0.0
    if len(hits) and len(second):
        at = np.searchsorted(second, hits)
        after = np.where(at < len(second), second[np.minimum(at, len(second) - 1)] - hits, 10**6)
        before = np.where(at > 0, hits - second[np.maximum(at - 1, 0)], 10**6)
        gap = np.minimum(after, before)
        proximity, near = 1.0 / float(gap.min() + 1), float((gap <= 5).sum())
    distinct = len({tokens[i].strip(_PLAIN_EDGE).lower() for i in hits.tolist()})
    upper = len(raw) - len(raw.translate(None, _UPPER))
    letters = len(raw) - len(raw.translate(None, _LETTER))
    share = lambda flag: float(np.count_nonzero(flags & flag)) / n
    return [
        math.log1p(len(tokens)),
        float(len(hits)),
        len(hits) / n,
        float(distinct),
        len(second) / n,
        proximity,
        near,
        share(_CAPS),
        upper / max(1, letters),
        raw.count(b"!") / size,
        (len(raw) - len(raw.translate(None, b".,;:!?\"'()"))) / size,
        (len(raw) - len(raw.translate(None, b"%$#*&@^~_|<>+="))) / size,
        share(_ODD),
        float(np.count_nonzero(flags & _HIDDEN)),
        share(_STRETCHED),
    ]


def features(docs: DataFrame, lexicon: list[str]) -> DataFrame:
    """(doc_id, text_hash, one double column per feature) of every whole text."""
    words = frozenset(lexicon)

    def run(batch: pa.RecordBatch):
        codes = worker_cache("toxicity").setdefault(("codes", words), _Codes(words))
        rows = [_features(t, codes) for t in batch.column("text").to_pylist()]
        columns = np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), *[pa.array(columns[:, i]) for i in range(len(FEATURES))]],
            ["doc_id", "text_hash", *FEATURES],
        )

    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text")
    )
    return texts.mapInArrow(per_batch(run), "doc_id long, text_hash long, " + ", ".join(f"{f} double" for f in FEATURES))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, fit_rows: int) -> DataFrame:
    """(doc_id, label) of about ``fit_rows`` rows outside the held-out fifth, chosen by a seeded hash of doc_id."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("double")).alias("label"))
    )
    n = known.count()
    return known.filter(seeded_unit(5, "fit", "doc_id") < fit_rows / max(1, n))


def learned_words(docs: DataFrame, fit: DataFrame, limit: int = LEARNED_WORDS) -> list[str]:
    """Words of the fitting rows that are far commoner in toxic texts (at most ``limit``)."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    each = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(fit, "doc_id")
    counted = (
        each.select("label", F.explode(words).alias("word"))
        .filter(F.length("word") > 2)
        .groupBy("word")
        .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    )
    total = fit.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    if not total[0] or not total[1]:
        return []
    odds = F.log((F.col("toxic") + 0.5) / (total[0] + 1)) - F.log((F.col("clean") + 0.5) / (total[1] + 1))
    common = F.greatest(F.lit(5.0), F.lit(0.02 * total[0]))
    top = counted.filter((F.col("toxic") >= common) & (odds > math.log(8))).orderBy(F.desc(odds * F.col("toxic")), "word").limit(limit)
    return sorted(r["word"] for r in top.collect())


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(doc_id, text_hash, held_out, score, predicted) of every row of ``docs`` (doc_id, text)."""
    fit = stored(training_labels(labels, fit_rows), "fit-labels")
    lexicon = sorted({*LEXICON, *learned_words(docs, fit)})
    table = stored(features(docs, lexicon), "toxicity-features")
    rows = stored(table.join(fit, "doc_id").select("doc_id", "label", *FEATURES), "fit-rows")
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    parts = rows.withColumn("part", seeded_unit(5, "calibrate", "doc_id"))
    learn, adjust = parts.filter("part >= 0.25"), parts.filter("part < 0.25")
    kinds = [{r["label"] for r in p.select("label").distinct().collect()} for p in (learn, adjust)]
    flag = held_out("doc_id").alias("held_out")
    if any(k != {0.0, 1.0} for k in kinds):
        share = rows.agg(F.avg("label")).first()[0] or 0.0
        scored = table.select("doc_id", "text_hash", flag, F.lit(float(share)).alias("score"))
    else:
        model = GBTClassifier(
            featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, maxBins=64, seed=5
        ).fit(assemble.transform(learn))
        probability = vector_to_array("probability")[1].alias("raw")
        calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(
            model.transform(assemble.transform(adjust)).select(probability, "label")
        )
        scored = calibration.transform(model.transform(assemble.transform(table)).select("doc_id", "text_hash", flag, probability))
        scored = scored.select("doc_id", "text_hash", "held_out", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    bad = stored(score(docs, labels).filter(F.col("score") >= threshold).select(F.col("doc_id").alias("b_id"), F.col("text_hash").alias("b_hash")).distinct(), "toxic")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("b_id")) & (F.xxhash64("text") == F.col("b_hash"))
    return docs.join(bad, same, "left_anti")
