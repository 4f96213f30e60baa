"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their prefixes of 4 to 6 letters,
hashed with CRC-32. The machine scores a text by a bias, a weight for each of its terms and
the products of the factors of each pair of its terms, so it can learn that two
terms mean more together (an insult and the mention of a group) than the sum of their weights.
Pairs are never listed: for each factor, their sum is half of the square of the sum less the sum of the squares.

Fitting: the labels' rows that aren't held out, of which the first `train_rows` in order of the
MD5 of their id are used (the bound of the sample), with all terms of their texts. The model's terms stand in at least
`least_rows` of these texts. They are the `common_terms` most common ones, whatever they mean alone, as a word may mean little
alone and much beside another; and those rarer ones, `most_terms` at most, whose chi-squared against the label is at least
`least_chi2`. They're counted in Spark, and only the sample's positions in them come to the driver.

Weights and factors are fitted there with AdaGrad. What pulls them to zero is taken off after each step and is scaled by the term's
own rate, so it can't be mistaken for evidence: a weight loses a constant, and so does the length of a term's factors. Terms
without evidence end at exactly 0, others keep theirs. The rates and pulls are those of `SETTINGS` whose machine has the least
log-loss on a third of the sample that it wasn't fitted on; if no pair of terms tells more than its
sum, that leaves factors near zero. The model is bounded by its parameters (under 1 MB) and broadcast.

Scoring: every whole text, batch by batch, no shuffle. Labels, language, source and id are no inputs.

Defined cases: a null text is empty; a text without a known term scores the bias; without labels of both kinds
every score is the share of label 1, or 0; labels that are null are left out, of repeated labels the largest
counts, and of repeated ids the smallest text; an empty table gives an empty result; extra columns stay
as they are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.llm.common import cut, id_text, table

TRAIN_ROWS = 12_000
LEAST_ROWS = 3
LEAST_CHI2 = 20.0
MOST_TERMS = 8192
COMMON_TERMS = 4096
FACTORS = 4
#: Passes over the sample: so many rows in all, within these limits.
ROWS_SEEN, LEAST_EPOCHS, MOST_EPOCHS = 60_000, 6, 60
BATCH = 128
#: Rows of the sample at most that a candidate's settings are fitted on.
TRIAL_ROWS = 4000
#: AdaGrad's rate of weights, and the size at which factors begin.
RATE, FACTOR_START = 0.5, 0.05
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
CACHED = 400_000
#: Hashes are below twice this.
HALF = 1 << 31


def term_hashes(word: str) -> list[int]:
    coded = [zlib.crc32(word.encode())]
    return coded + [zlib.crc32(f"{word[:n]}*".encode()) for n in PREFIXES if len(word) >= n]


@dataclass(frozen=True)
class Settings:
    """AdaGrad's rate of factors, and the pulls to zero of weights and of factors."""

    rate_v: float
    pull: float
    pull_v: float


#: The candidates, of which the sample chooses.
SETTINGS = (Settings(0.1, 1e-4, 1e-3), Settings(0.1, 1e-4, 3e-4), Settings(0.05, 3e-4, 3e-4))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(id_text(id_col).cast("binary")) % FOLDS == HELD_OUT


@dataclass
class Model:
    """terms: sorted hashes; weights and factors in their order."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, rows: list[list[int]]) -> np.ndarray:
        """The machine's value for texts given as positions of their terms."""
        out = np.full(len(rows), self.bias)
        for k, at in enumerate(rows):
            if at:
                v = self.factors[at]
                out[k] += self.weights[at].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum()
        return out


def _probability(margins: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margins, -35, 35)))


def _batch(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All positions of these texts, the text of each, and where each text that has any begins, with that text."""
    sizes = np.array([len(r) for r in rows])
    having = np.flatnonzero(sizes)
    return np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes), (np.cumsum(sizes) - sizes)[having], having


def _epochs(n: int, rows_seen: int) -> int:
    return min(MOST_EPOCHS, max(LEAST_EPOCHS, rows_seen // n))


def machine(texts: list[np.ndarray], labels: np.ndarray, n_terms: int, settings: Settings, factors: int = FACTORS, epochs: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, weights, factors) after `epochs` passes. Factors begin to move after a sixth of them, when weights tell what terms mean alone."""
    n, positive = len(texts), float(labels.sum())
    epochs = epochs or _epochs(n, ROWS_SEEN)
    random = np.random.default_rng(7)
    w, v, b = np.zeros(n_terms), random.normal(0, FACTOR_START, (n_terms, factors)), math.log(positive / (n - positive))
    gw, gv, gb = np.full(n_terms, 1e-8), np.full(n_terms, 1e-8), 1e-8
    for epoch in range(epochs):
        order = random.permutation(n)
        for at in range(0, n, BATCH):
            batch = order[at : at + BATCH]
            terms, row, starts, having = _batch([texts[k] for k in batch])
            mine = v[terms]
            total, alone = np.zeros((len(batch), factors)), np.zeros(len(batch))
            if len(terms):
                total[having] = np.add.reduceat(mine, starts, axis=0)
                alone[having] = np.add.reduceat(w[terms] - 0.5 * (mine * mine).sum(axis=1), starts)
            margin = b + alone + 0.5 * (total * total).sum(axis=1)
            error = (_probability(margin) - labels[batch]) / len(batch)
            per_term = error[row]
            touched = np.flatnonzero(np.bincount(terms, minlength=n_terms))
            dw = np.bincount(terms, per_term, n_terms)[touched]
            gw[touched] += dw * dw
            step = RATE / np.sqrt(gw[touched])
            moved = w[touched] - step * dw
            w[touched] = np.sign(moved) * np.maximum(0.0, np.abs(moved) - step * settings.pull)
            if epoch >= epochs // 6:
                slope = per_term[:, None] * (total[row] - mine)
                dv = np.stack([np.bincount(terms, slope[:, k], n_terms)[touched] for k in range(factors)], axis=1)
                gv[touched] += (dv * dv).mean(axis=1)
                step = settings.rate_v / np.sqrt(gv[touched])
                moved = v[touched] - step[:, None] * dv
                size = np.sqrt((moved * moved).sum(axis=1))
                v[touched] = moved * np.maximum(0.0, 1 - step * settings.pull_v / np.maximum(size, 1e-12))[:, None]
            gb += error.sum() ** 2
            b -= RATE * error.sum() / math.sqrt(gb)
    return b, w, v


def chosen_settings(texts: list[np.ndarray], labels: np.ndarray, n_terms: int, factors: int) -> Settings:
    """The settings whose machine, fitted on two thirds of the texts (TRIAL_ROWS at most), has the least log-loss on the other third."""
    place = np.random.default_rng(11).permutation(len(texts))
    fitted, judged = np.flatnonzero(place % 3 > 0), np.flatnonzero(place % 3 == 0)
    fitted = fitted[np.argsort(place[fitted])][:TRIAL_ROWS]
    if labels[fitted].sum() in (0, len(fitted)) or not len(judged):
        return SETTINGS[0]
    losses = []
    for settings in SETTINGS:
        made = Model(np.zeros(0, np.int64), *machine([texts[k] for k in fitted], labels[fitted], n_terms, settings, factors, _epochs(len(fitted), ROWS_SEEN // 3)))
        p = np.clip(_probability(made.margins([texts[k].tolist() for k in judged])), 1e-6, 1 - 1e-6)
        losses.append(-np.where(labels[judged] == 1, np.log(p), np.log(1 - p)).mean())
    return SETTINGS[int(np.argmin(losses))]


def train(texts: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, factors: int = FACTORS) -> Model:
    """texts: positions in terms; labels: 0 or 1."""
    n, positive = len(texts), int(labels.sum())
    if positive in (0, n):
        share = positive / n if n else 0.0
        return Model(np.zeros(0, np.int64), math.log(max(share, 1e-9) / max(1 - share, 1e-9)), np.zeros(0), np.zeros((0, factors)))
    return Model(terms, *machine(texts, labels, len(terms), chosen_settings(texts, labels, len(terms), factors), factors))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to (id, label, terms); a term is its hash less 2**31."""
    for batch in batches:
        found = []
        for text in batch.column(2).to_pylist():
            got: set[int] = set()
            for word in set(WORD.findall(text.lower())):
                got.update(term_hashes(word))
            found.append([h - HALF for h in sorted(got)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "label", "terms"])


def _chosen(features: DataFrame, least_rows: int, least_chi2: float, most_terms: int, common_terms: int) -> np.ndarray:
    """The sorted hashes of the model's terms; features: (id, label, terms)."""
    n, positive = features.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if positive in (0, n):
        return np.zeros(0, np.int64)
    share = positive / n
    counted = features.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("label").alias("ones"))
    spread = F.col("df") * share * (1 - share) * (1 - F.col("df") / n)
    chi2 = F.coalesce(F.try_divide((F.col("ones") - F.col("df") * share) ** 2, spread), F.lit(0.0))
    scored = cut(counted.withColumn("chi2", chi2).where(F.col("df") >= least_rows))
    common = scored.orderBy(F.col("df").desc(), "term").limit(common_terms)
    strong = scored.where(F.col("chi2") >= least_chi2).orderBy(F.col("chi2").desc(), "term").limit(most_terms)
    return np.array(sorted({r[0] for r in common.union(strong).select("term").collect()}), np.int64) + HALF


def _positions(terms: np.ndarray):
    """A function for mapInArrow: each text's terms to their positions in the model's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.column(2):
                hashes = row.values.to_numpy().astype(np.int64) + HALF
                at = np.searchsorted(terms, hashes)
                at = at[np.take(terms, at, mode="clip") == hashes] if len(terms) else at[:0]
                found.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "label", "terms"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, least_rows: int = LEAST_ROWS, least_chi2: float = LEAST_CHI2, most_terms: int = MOST_TERMS, common_terms: int = COMMON_TERMS) -> Model:
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    sample = known.orderBy(F.md5(F.col("id").cast("string")), "id").limit(train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text"))
    schema = "id long, label int, terms array<int>"
    features = cut(texts.select("id", "label", "text").mapInArrow(_features, schema))
    terms = _chosen(features, least_rows, least_chi2, most_terms, common_terms)
    got = features.mapInArrow(_positions(terms), schema).toArrow().sort_by("id")
    rows = [np.asarray(r, np.int64) for r in got.column("terms").to_pylist()]
    return train(rows, got.column("label").to_numpy().astype("f8"), terms)


def scorer(spark: SparkSession, model: Model):
    """A function of a text column that gives its score."""
    sent = spark.sparkContext.broadcast((model.terms, model.bias, model.weights, model.factors))

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(*sent.value)
        place = {int(h): k for k, h in enumerate(model.terms)}
        cache: dict[str, list[int]] = {}
        for part in texts:
            rows = []
            for text in part.to_pylist():
                at: set[int] = set()
                for word in set(WORD.findall((text or "").lower())):
                    got = cache.get(word)
                    if got is None:
                        if len(cache) >= CACHED:
                            cache.clear()
                        got = cache[word] = [place[h] for h in term_hashes(word) if h in place]
                    if got:
                        at.update(got)
                rows.append(sorted(at))
            yield pa.array(_probability(model.margins(rows)))

    return score


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    return docs.withColumn(score_col, scorer(docs.sparkSession, model)(F.col(text_col)))


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores under the threshold, with the columns that they had."""
    return docs.where(scorer(docs.sparkSession, model)(F.col(text_col)) < threshold)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
