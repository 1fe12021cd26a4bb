"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over the presence of words and beginnings of words: for each category those that its
labels depend on most. Each later model also gets the
earlier categories' probabilities; in training these are out-of-fold predictions, so that they look like
those of unseen documents. Training uses a bounded sample of labelled documents, chosen by a hash of their ids;
scoring covers every document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: Categories in the order of the chain; the last one decides.
CHAIN = ("low_quality", "toxic")
#: Words for each category at most, in so many labelled documents at least, and so many standard deviations from independence; folds; labelled documents used at most (by hash of the id);
#: probability from which a document is toxic.
WORDS, WORD_DOCS, DISTANCE, FOLDS, TRAIN_ROWS, THRESHOLD = 1_000, 3, 5.0, 3, 20_000, 0.5
#: Lengths of the beginnings of words that are features too.
BEGINNINGS = (5, 6, 7, 8)
#: Penalty and most steps of the linear models.
PENALTY, STEPS = 5e-4, 40


def _beginnings(k: int) -> Column:
    return F.transform(F.filter("_words", lambda w: F.length(w) > k), lambda w: F.concat(F.lit("^"), F.substring(w, 1, k)))


def _words(docs: DataFrame) -> DataFrame:
    """The documents with `_words`, their distinct words in lower case and the beginnings of longer ones, so that inflected forms count together."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)))
    begins = [_beginnings(k) for k in BEGINNINGS]
    return docs.withColumn("_words", words).withColumn("_words", F.array_distinct(F.concat("_words", *begins)))


def vocabulary(rows: DataFrame, categories: tuple[str, ...], most: int = WORDS, least: int = WORD_DOCS) -> list[str]:
    """The words of rows(_words, categories) whose presence says most about a category: `most` for each, by distance from independence."""
    total = rows.agg(*[F.count(c).alias(f"n_{c}") for c in categories], *[F.sum(c).alias(f"y_{c}") for c in categories]).first()
    counts = rows.select(F.explode("_words").alias("word"), *categories).groupBy("word").agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in categories], *[F.sum(c).alias(f"y_{c}") for c in categories])
    counts = cut(counts.where(F.col("n") >= least), "words")
    chosen: set[str] = set()
    for c in categories:
        share = (total[f"y_{c}"] or 0) / max(total[f"n_{c}"], 1)
        if 0 < share < 1:
            far = F.abs(F.col(f"y_{c}") - F.col(f"n_{c}") * share) / F.sqrt(F.col(f"n_{c}") * share * (1 - share))
            chosen |= {r["word"] for r in counts.where((F.col(f"n_{c}") > 0) & (far >= DISTANCE)).orderBy(far.desc(), "word").limit(most).select("word").collect()}
    drop_cut(counts)
    return sorted(chosen) or [""]


def _featured(docs: DataFrame, words: list[str]) -> DataFrame:
    """The documents with `words`, which of the vocabulary's words they have, as a sparse vector."""
    return CountVectorizerModel.from_vocabulary(words, inputCol="_words", outputCol="words", binary=True).transform(docs).drop("_words")


def _fit(rows: DataFrame, label: str, inputs: list[str]) -> LogisticRegressionModel | float:
    """A model, or the one probability if the rows have one class only."""
    seen = rows.agg(F.count(label).alias("n"), F.avg(F.col(label).cast("double")).alias("p")).first()
    if not seen["n"] or seen["p"] in (0.0, 1.0):
        return float(seen["p"] or 0.0)
    made = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows.where(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double")))
    return LogisticRegression(maxIter=STEPS, regParam=PENALTY, standardization=False, probabilityCol="probability").fit(made.select("features", "label"))


def _predict(rows: DataFrame, model: LogisticRegressionModel | float, inputs: list[str], name: str) -> DataFrame:
    if isinstance(model, float):
        return rows.withColumn(name, F.lit(model))
    made = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows)
    return model.transform(made).withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


class Chain:
    """A trained chain: one model for each category."""

    def __init__(self, words: list[str], models: list[tuple[str, list[str], LogisticRegressionModel | float]]):
        self.words, self.models = words, models

    def applied(self, docs: DataFrame) -> DataFrame:
        """_row, the whole document, and p_<category> for each category."""
        out = _featured(_words(docs.select(F.struct(*docs.columns).alias("_row"), "text")), self.words)
        for category, inputs, model in self.models:
            out = _predict(out, model, inputs, f"p_{category}")
        return out.select("_row", *[f"p_{category}" for category, _, _ in self.models])

    def scored(self, docs: DataFrame) -> DataFrame:
        """The documents with p_<category> for each category; all other columns stay, those of such a name are replaced."""
        found = [f"p_{category}" for category, _, _ in self.models]
        return self.applied(docs).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in found], *found)


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CHAIN, most: int = TRAIN_ROWS, folds: int = FOLDS) -> Chain:
    """A chain from docs(doc_id, text) and labels(doc_id, one 0/1 column for each category); null labels are not used.

    At most `most` labelled documents are used, those with the smallest hash of their id.
    """
    chosen = labels.where("doc_id is not null").withColumn("_order", F.xxhash64("doc_id")).orderBy("_order", "doc_id").limit(most)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `most` rows
    spelled = cut(_words(sample).withColumn("_fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds))).select("_fold", "_words", *categories), "labelled")
    words = vocabulary(spelled, categories)
    rows = cut(_featured(spelled, words), "labelled")
    drop_cut(spelled)
    inputs, models = ["words"], []
    for place, category in enumerate(categories):
        models.append((category, list(inputs), _fit(rows, category, inputs)))
        if place + 1 < len(categories):
            parts = [_predict(rows.where(F.col("_fold") == k), _fit(rows.where(F.col("_fold") != k), category, inputs), inputs, f"p_{category}") for k in range(folds)]
            before, rows = rows, cut(reduce(DataFrame.unionByName, parts), "labelled")
            drop_cut(before)
            inputs = [*inputs, f"p_{category}"]
    drop_cut(rows)
    return Chain(words, models)


def from_quality(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) as the chain's categories."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, toxic) for every row of docs(doc_id, text, ...).

    toxic is p_toxic of THRESHOLD or more. A null or empty text has no words and gets what the intercepts say. Without labels, or with one class
    only, the probability is that class's share (0 without any). Null doc_id stays null, repeated rows stay repeated, further columns are
    ignored, no rows give no rows.
    """
    scored = train(docs, from_quality(labels)).scored(docs.select("doc_id", "text"))
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= THRESHOLD).alias("toxic"))


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that score() does not call toxic."""
    kept = train(docs, from_quality(labels)).applied(docs).where(F.col("p_toxic") < THRESHOLD)
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
