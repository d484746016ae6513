"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme values.

Tokens are the words (letters only) and their beginnings of a few lengths, so that compounds of a
known stem are known. A token's score is its log-odds between toxic and other labelled texts (by the texts that
hold it) under a Dirichlet prior proportional to its count in all documents. Every word takes the score of its surest token less a drift; a
linear scan (Ruzzo and Tompa) finds all maximal segments. Against ordinary text the best segment of
n words exceeds S with about K n exp(-lambda S) expected cases: lambda solves
sum p exp(lambda s) = 1 over the scores of ordinary words, K is fitted to the best segments of
ordinary texts. Minus the logarithms of those expectations, summed over the significant segments, go through a
logistic regression.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import materialise, query, table
from tidewatch.llm.logistic import Logistic, sigmoid
from tidewatch.llm.shingles import ByteSums, byte_blocks, find_words

#: Labelled rows that are fitted at most, those of the least hashed ids; tokens of the model at most.
TRAIN_ROWS, MODEL_TOKENS = 20_000, 20_000
#: Bytes of the word beginnings that are tokens.
STEMS = (4, 5, 6, 7, 8, 9)
#: Weight of the prior against the toxic texts, score taken from each word.
PRIOR, DRIFT = 0.25, 1.0
#: Bounds of a token's score.
LOWEST, HIGHEST = -1.0, 8.0
#: A segment is significant when fewer than this many are expected by chance.
EXPECTED = 0.05
THRESHOLD = 0.7

_NO_LETTER = np.array([not (chr(b).isalpha() or b >= 0x80) if b < 0x80 else False for b in range(256)])


def _words(column: pa.Array):
    """For runs of texts: index of the first, bytes, offsets, word spans, first words, token hashes by kind."""
    for at, data, offsets in byte_blocks(column):
        if not len(data):
            yield at, data, offsets, np.empty(0, int), np.empty(0, int), np.zeros(len(offsets), int), None
            continue
        first, last, word = find_words(data, offsets, _NO_LETTER)
        sums = ByteSums(data)
        end = last + 1
        tokens = [sums.hashes(first, end)]
        for stem in STEMS:
            cut = np.minimum(first + stem, end)
            tokens.append(np.where(cut < end, sums.hashes(first, cut) + np.uint64(stem), np.uint64(0)))
        yield at, data, offsets, first, end, word, np.stack(tokens)


class Tokens:
    """Token hashes of a model, sorted, for lookup."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where unknown."""
        out = np.full(wanted.shape, -1, np.int64)
        maybe = self.table[(wanted >> np.uint64(44)).astype(np.int64)] & (wanted != 0)
        own = wanted[maybe]
        at = np.minimum(np.searchsorted(self.hashes, own), max(0, len(self.hashes) - 1))
        out[maybe] = np.where(self.hashes[at] == own, at, -1) if len(self.hashes) else -1
        return out


class Model:
    """Token scores, and what turns segment scores into a probability."""

    def __init__(self, tokens: Tokens, scores: np.ndarray, certainty: np.ndarray):
        self.tokens, self.scores, self.certainty = tokens, scores, certainty
        self.rate, self.factor, self.logistic = 1.0, 1.0, None

    def word_scores(self, hashes: np.ndarray | None) -> np.ndarray:
        if hashes is None:
            return np.empty(0)
        at = self.tokens.places(hashes)
        sure = np.where(at >= 0, self.certainty[at] if len(self.certainty) else 0.0, 0.0)
        best = sure.argmax(axis=0)
        column = np.arange(hashes.shape[1])
        score = self.scores[at[best, column]] if len(self.scores) else np.zeros(len(column))
        return np.where(sure[best, column] > 0, score, 0.0) - DRIFT

    def surprise(self, score: float, n: int) -> float:
        """Minus the logarithm of the cases expected in n ordinary words."""
        return self.rate * score - np.log(self.factor * max(n, 1))


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, end), by one scan over the words.

    Ruzzo and Tompa's algorithm; words that score below 0 only matter through the running sum.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[float, float, int, int]] = []  # sum before, sum at end, first, end
    for i in np.nonzero(scores > 0)[0]:
        left, right, first = total[i], total[i + 1], int(i)
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][0] >= left:
                k -= 1
            if k < 0 or found[k][1] >= right:
                break
            left, first = found[k][0], found[k][2]
            del found[k:]
        found.append((left, right, first, int(i) + 1))
    return [(float(r - l), a, b) for l, r, a, b in found]


def _evidence(model: Model, column: pa.Array):
    """Per text: summed surprise of the significant segments, best score, words, those segments."""
    for _, data, offsets, first, end, word, hashes in _words(column):
        scores = model.word_scores(hashes)
        positive = np.concatenate([[0], np.cumsum(scores > 0)])
        for i, (a, b) in enumerate(zip(word, word[1:])):
            n = int(b - a)
            if positive[b] == positive[a]:
                yield 0.0, 0.0, n, []
                continue
            parts = [(model.surprise(s, n), s, x + a, y + a) for s, x, y in segments(scores[a:b])]
            least = -np.log(EXPECTED)
            good = [p for p in parts if p[0] >= least]
            text = data[offsets[i] : offsets[i + 1]]
            points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)]) if good else None
            spans = [
                {
                    "start": int(points[first[x] - offsets[i]]),
                    "end": int(points[end[y - 1] - offsets[i]]),
                    "surprise": float(e),
                }
                for e, _, x, y in good
            ]
            yield sum(p[0] for p in good), max(p[1] for p in parts), n, spans


def _features(total) -> np.ndarray:
    return np.log1p(np.asarray(total, float))[:, None]


def _counted(batches):
    """Tokens of labelled texts: for each run of texts and label the texts that hold each hash."""
    for batch in batches:
        toxic = np.array(batch.column(1).to_pylist(), bool)
        for at, _, _, _, _, word, hashes in _words(batch.column(0)):
            if hashes is None:
                continue
            held: tuple[list, list] = ([], [])
            for i, (a, b) in enumerate(zip(word, word[1:])):
                held[int(toxic[at + i])].append(np.unique(hashes[:, a:b]))
            for label, parts in enumerate(held):
                own = np.concatenate([np.empty(0, np.uint64), *parts])
                found, n = np.unique(own[own != 0], return_counts=True)
                columns = [found.view(np.int64), np.full(len(found), bool(label)), n]
                yield pa.record_batch([pa.array(c) for c in columns], ["token", "toxic", "n"])


def _background(tokens):
    def run(batches):
        known = tokens.value
        counts = np.zeros(len(known.hashes) + 1, np.int64)
        for batch in batches:
            for *_, hashes in _words(batch.column(0)):
                if hashes is not None:
                    at = known.places(hashes).ravel()
                    counts += np.bincount(np.where(at < 0, len(known.hashes), at), minlength=len(counts))
        at = np.nonzero(counts)[0]
        yield pa.record_batch([pa.array(at), pa.array(counts[at])], ["place", "n"])

    return run


def _log_odds(toxic, other, prior, n_toxic, n_other, all_prior):
    """Log-odds ratio of the two Dirichlet posteriors."""
    a, b = toxic + prior, other + prior
    return np.log(a / (n_toxic + all_prior - a)) - np.log(b / (n_other + all_prior - b))


def _rate(scores: np.ndarray, counts: np.ndarray) -> float:
    """Positive root of mean(exp(rate * score)) = 1, with one more word of the highest score."""
    scores = np.append(scores, max(scores.max(initial=0.0), 1.0))
    share = np.append(counts, 1.0) / (counts.sum() + 1)

    def excess(rate):
        return float((share * np.exp(np.clip(rate * scores, None, 50))).sum()) - 1

    if (share * scores).sum() >= 0:
        return 0.1
    low, high = 1e-6, 1.0
    while excess(high) < 0:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return low


def fit(docs: DataFrame, labelled: DataFrame) -> Model | None:
    """docs: text; labelled: text, toxic (TRAIN_ROWS rows at most). None without texts of both labels."""
    spark = docs.sparkSession
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    counted = labelled.select("text", "toxic").mapInArrow(_counted, "token long, toxic boolean, n long")
    by_token = materialise(
        counted.groupBy("token").agg(
            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
            F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("other"),
        ),
        "toxicity-tokens",
    )
    n_toxic, n_other, n_tokens = map(
        float, by_token.agg(F.sum("toxic"), F.sum("other"), F.count("*")).first()
    )
    # Twice the log-likelihood ratio; chance alone hardly passes 2 log(tokens) in so many tokens.
    both = F.col("toxic") + F.col("other")
    terms = [(F.col("toxic"), n_toxic), (F.col("other"), n_other)]
    surest = sum(
        F.when(n > 0, 2 * n * F.log(n * (n_toxic + n_other) / (both * size))).otherwise(0.0) for n, size in terms
    )
    chosen = (
        by_token.withColumn("surest", surest)
        .filter(F.col("surest") >= 2 * np.log(max(2.0, n_tokens)))
        .orderBy(F.desc("surest"), "token")
        .limit(MODEL_TOKENS)
        .toArrow()
        .sort_by("token")
    )
    hashes = chosen["token"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    tokens = Tokens(hashes)
    counts = [chosen[c].to_numpy()[order].astype(float) for c in ("toxic", "other")]
    places = spark.sparkContext.broadcast(tokens)
    seen = docs.select("text").mapInArrow(_background(places), "place long, n long")
    seen = seen.groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # MODEL_TOKENS + 1 rows at most
    everywhere = np.zeros(len(hashes) + 1)
    everywhere[seen["place"].to_numpy()] = seen["n"].to_numpy()
    prior = PRIOR * n_toxic * (everywhere[:-1] + 1) / (everywhere.sum() + len(hashes))
    odds = _log_odds(*counts, prior, n_toxic, n_other, PRIOR * n_toxic)
    model = Model(tokens, np.clip(odds, LOWEST, HIGHEST), chosen["surest"].to_numpy()[order])

    return _calibrated(model, labelled)


def _histogram(model):
    """Scores of ordinary words, rounded, and how often."""

    def run(batches):
        for batch in batches:
            for *_, hashes in _words(batch.column(0)):
                score, n = np.unique(np.round(model.value.word_scores(hashes), 2), return_counts=True)
                yield pa.record_batch([pa.array(score), pa.array(n)], ["score", "n"])

    return run


def _summaries(model):
    def run(batches):
        for batch in batches:
            found = [f[:3] for f in _evidence(model.value, batch.column(0))]
            total, best, n = zip(*found) if found else ((), (), ())
            columns = [pa.array(total, pa.float64()), pa.array(best, pa.float64()), pa.array(n, pa.int64())]
            yield pa.record_batch([*columns, batch.column(1)], ["total", "best", "n", "toxic"])

    return run


def _calibrated(model: Model, labelled: DataFrame) -> Model:
    """Only numbers come to the driver: a histogram, and three for each of the TRAIN_ROWS texts."""
    send = labelled.sparkSession.sparkContext.broadcast
    scores = labelled.filter("NOT toxic").select("text").mapInArrow(_histogram(send(model)), "score double, n long")
    scores = scores.groupBy("score").agg(F.sum("n").alias("n")).toArrow()
    model.rate = _rate(scores["score"].to_numpy(), scores["n"].to_numpy().astype(float))

    def summaries():
        rows = labelled.select("text", "toxic").mapInArrow(
            _summaries(send(model)), "total double, best double, n long, toxic boolean"
        )
        return {name: column.to_numpy() for name, column in zip(rows.columns, rows.toArrow().columns)}

    found = summaries()
    ordinary = ~found["toxic"].astype(bool)
    n, best = np.maximum(found["n"][ordinary], 1), found["best"][ordinary]
    model.factor = len(best) / max(1e-9, float((n * np.exp(-model.rate * best)).sum()))
    found = summaries()
    model.logistic = Logistic(_features(found["total"]), found["toxic"].astype(float), penalty=0.1)
    return model


_PASSAGES = "array<struct<start: int, end: int, surprise: double>>"


def _scored(model, names: list[str]):
    def run(batches):
        fitted = model.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("__text"))
            found = list(_evidence(fitted, text))
            score = sigmoid(fitted.logistic.margin(_features([f[0] for f in found])))
            kind = pa.list_(
                pa.struct([("start", pa.int32()), ("end", pa.int32()), ("surprise", pa.float64())])
            )
            kept = batch.select(names)
            kept = kept.append_column("score", pa.array(score, pa.float64()))
            yield kept.append_column("passages", pa.array([f[3] for f in found], kind))

    return run


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: id, held_out, score, predicted, passages.

    Labels are learned from ids whose crc32 (of the id as text) modulo 3 is not 1, TRAIN_ROWS of them at
    most; the others are held out. An id with several labels has the highest; NULL labels and
    ids without a document teach nothing. score is between 0 and 1, higher for likelier toxic; predicted is 1 from
    `threshold` on. passages are the significant segments, in code points of the text. NULL counts as
    empty; empty texts have the score of a text without any evidence. Repeated rows are scored alike. Without
    labelled documents of both kinds every score is 0. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
        .filter(F.col("label").isNotNull() & (rest != 1))
        .groupBy("doc_id")
        .agg((F.max("label") > 0).alias("toxic"))
    )
    known = materialise(
        known.join(rows.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS),
        "toxicity-labels",
    )
    labelled = rows.join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic")
    labelled = materialise(labelled.dropDuplicates(["doc_id"]).select("text", "toxic"), "toxicity-labelled")
    model = fit(rows, labelled)
    held_out = F.coalesce(rest == 1, F.lit(False)).alias("held_out")
    if model is None:
        nothing = F.array().cast(_PASSAGES)
        scored = rows.select("doc_id", F.lit(0.0).alias("score"), nothing.alias("passages"))
    else:
        kind = rows.schema["doc_id"].dataType.simpleString()
        scored = rows.withColumnRenamed("text", "__text").mapInArrow(
            _scored(spark.sparkContext.broadcast(model), ["doc_id"]),
            f"doc_id {kind}, score double, passages {_PASSAGES}",
        )
    return scored.select(
        "doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages"
    )


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
