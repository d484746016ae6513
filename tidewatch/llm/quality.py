"""Quality by co-training on two views of a document: what the text is like, and what is known about its page.

Each view has a logistic regression. In every round each view labels the documents without a
label; those of which it is surest teach the other view. At last both views' margins are calibrated
together on labelled rows that neither has seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import TEXT_ROWS, arrow_batches, giving_back, materialise, query, table
from tidewatch.llm.logistic import Logistic
from tidewatch.llm.shingles import ByteSums, byte_blocks, find_words

#: Labelled rows that are fitted at most (those of the least hashed ids), and the part kept for calibration.
LABELLED_ROWS, CALIBRATION = 20_000, 0.25
#: Rounds; pseudo-labels of each class that a view gives in a round at most, and how sure it must be.
ROUNDS, EXCHANGED, SURE = 3, 1000, 0.95
THRESHOLD = 0.5
#: Cells of language and source in the page view.
LANGUAGES, SOURCES = 8, 16

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 0xC0)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_POINT = (_BYTES & 0xC0) != 0x80
_MARK = np.isin(_BYTES, [ord(c) for c in ".,;:'\"-?()"])
_SYMBOL = (_BYTES > 32) & (_BYTES < 127) & ~_LETTER & ~_DIGIT & ~_MARK
_LINE = _BYTES == 10
_BANG = _BYTES == 33

#: Features of the views, in order.
CONTENT = ("upper", "symbols", "digits", "bangs", "repeats", "distinct", "richness", "odd_ends", "length", "words")
PAGE = ("chars", "lines", "line_length", *(f"lang{i}" for i in range(LANGUAGES)), *(f"source{i}" for i in range(SOURCES)))


def content_features(column: pa.Array):
    """For runs of texts: CONTENT features, and lines and code points."""
    for _, data, offsets in byte_blocks(column):
        def total(mask):
            sums = np.concatenate([[0], np.cumsum(mask)])
            return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

        points, letters = total(_POINT[data]), total(_LETTER[data])
        n = len(offsets) - 1
        words = repeats = odd = size = distinct = np.zeros(n)
        if len(data):
            first, last, at = find_words(data, offsets)
            hashes = ByteSums(data).hashes(first, last + 1)
            same = np.zeros(len(hashes), bool)
            same[1:] = hashes[1:] == hashes[:-1]
            inner = at[(at > 0) & (at < len(hashes))]
            same[inner] = False

            def by_text(values):
                sums = np.concatenate([[0], np.cumsum(values)])
                return (sums[at[1:]] - sums[at[:-1]]).astype(float)

            words, repeats = np.diff(at).astype(float), by_text(same)
            odd, size = by_text(_SYMBOL[data[last]]), by_text(last + 1 - first)
            distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(at, at[1:])], float)
        some, chars = np.maximum(words, 1), np.maximum(points, 1)
        features = np.stack(
            [
                total(_UPPER[data]) / np.maximum(letters, 1),
                total(_SYMBOL[data]) / chars,
                total(_DIGIT[data]) / chars,
                total(_BANG[data]) / chars,
                repeats / some,
                distinct / some,
                np.log1p(distinct) / np.log1p(some),
                odd / some,
                size / some,
                np.log1p(words),
            ],
            axis=1,
        )
        yield features, total(_LINE[data]) + 1, points


def _content(names: list[str], text_col: str):
    """The batch with arrays `__content` and `__page` (chars, lines, line_length)."""

    def run(batches):
        for batch in batches:
            parts = list(content_features(batch.column(batch.schema.get_field_index(text_col))))
            if not parts:
                continue
            content, lines, points = (np.concatenate(c) for c in zip(*parts))
            page = np.stack([np.log1p(points), np.log1p(lines), np.log1p(points / lines)], axis=1)
            kept = batch.select(names)
            kept = kept.append_column("__content", pa.array(list(content), pa.list_(pa.float64())))
            yield kept.append_column("__page", pa.array(list(page), pa.list_(pa.float64())))

    return run


def with_views(docs: DataFrame, keep: list[str], text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """`keep` columns of docs with the arrays __content and __page."""
    needed = list(dict.fromkeys([*keep, text_col, lang_col, source_col]))
    kept = list(dict.fromkeys([*keep, lang_col, source_col]))
    rows = docs.select(*needed)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    made = rows.mapInArrow(
        giving_back(_content(kept, text_col)), fields + ", __content array<double>, __page array<double>"
    )

    def cells(column, n):
        cell = F.pmod(F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(n))
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == cell).cast("double"))

    page = F.concat("__page", cells(lang_col, LANGUAGES), cells(source_col, SOURCES))
    return made.withColumn("__page", page).select(*keep, "__content", "__page")


def _margin(array: str, model: Logistic):
    """The model's linear score as a DataFrame expression."""
    total = F.lit(model.intercept)
    for i, w in enumerate(model.weights):
        total = total + F.lit(float(w)) * F.element_at(array, i + 1)
    return total


class Views:
    """The fitted views and their joint calibration."""

    def __init__(self, content: Logistic, page: Logistic, joint: Logistic):
        self.content, self.page, self.joint = content, page, joint

    def scored(self, rows: DataFrame) -> DataFrame:
        """Columns content_score, page_score (each view's own) and score of rows with both views."""
        rows = rows.withColumn("__c", _margin("__content", self.content))
        rows = rows.withColumn("__p", _margin("__page", self.page))

        def logistic(x):
            return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))

        a, b = (float(w) for w in self.joint.weights)
        joint = F.lit(self.joint.intercept) + F.lit(a) * F.col("__c") + F.lit(b) * F.col("__p")
        return rows.select(
            "*",
            logistic(F.col("__c")).alias("content_score"),
            logistic(F.col("__p")).alias("page_score"),
            logistic(joint).alias("score"),
        ).drop("__c", "__p")


def _matrix(rows, column) -> np.ndarray:
    return np.array([r[column] for r in rows], float).reshape(len(rows), -1)


def co_train(views: DataFrame) -> Views | None:
    """views: doc_id, label (NULL: none), __content, __page. None without labels of both classes."""
    labelled = (
        views.filter("label is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS).collect()
    )
    y = np.array([r["label"] for r in labelled], float)
    if not labelled or y.min() == y.max():
        return None
    c, p = _matrix(labelled, "__content"), _matrix(labelled, "__page")
    held = np.arange(len(y)) % round(1 / CALIBRATION) == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    teach = {"content": (c[~held], y[~held]), "page": (p[~held], y[~held])}
    unlabelled = views.filter("label is null")
    for round_ in range(ROUNDS + 1):
        models = {view: Logistic(*teach[view]) for view in teach}
        if round_ == ROUNDS:
            break
        edge = float(np.log(SURE / (1 - SURE)))
        for view, other in (("content", "page"), ("page", "content")):
            margin = unlabelled.withColumn("__m", _margin(f"__{view}", models[view]))
            picked, labels = [], []
            for label, sign in ((1.0, 1), (0.0, -1)):
                sure = margin.filter(sign * F.col("__m") >= edge)
                rows = sure.orderBy(F.desc(sign * F.col("__m")), "doc_id").limit(EXCHANGED).collect()
                picked += rows
                labels += [label] * len(rows)
            own = (c if other == "content" else p)[~held], y[~held]
            if picked:
                x = np.vstack([own[0], _matrix(picked, f"__{other}")])
                teach[other] = x, np.concatenate([own[1], labels])
    use = held if held.any() else np.ones(len(y), bool)
    margins = np.stack([models["content"].margin(c[use]), models["page"].margin(p[use])], axis=1)
    return Views(models["content"], models["page"], Logistic(margins, y[use], penalty=0.1))


def _labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("q")).filter("q is not null")
    return known.groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("int").alias("label"))


def _fitted(docs, labels, id_col, text_col, lang_col, source_col, label_col):
    views = with_views(docs, [id_col], text_col, lang_col, source_col).withColumnRenamed(id_col, "doc_id")
    views = views.join(_labels(labels, id_col, label_col), "doc_id", "left")
    with arrow_batches(docs.sparkSession, TEXT_ROWS):
        views = materialise(views, "quality-views")
    return views, co_train(views)


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: id, content_score, page_score, score, keep (score >= threshold).

    Scores are between 0 and 1, higher for likelier label 1. At most LABELLED_ROWS labels are fitted; an id with
    several labels has their majority; NULL labels teach nothing. NULL texts count as empty, NULL languages
    and sources as empty strings. Repeated rows are scored alike, also those that share a NULL id.
    Without labels of both classes every score is 1. An empty table gives no rows; other columns are ignored.
    """
    views, model = _fitted(docs, labels, id_col, text_col, lang_col, source_col, label_col)
    return _judged(views, model, threshold).select("doc_id", "content_score", "page_score", "score", "keep")


def _judged(views: DataFrame, model: Views | None, threshold: float) -> DataFrame:
    if model is None:
        one = F.lit(1.0)
        scored = views.select("*", one.alias("content_score"), one.alias("page_score"), one.alias("score"))
    else:
        scored = model.scored(views)
    return scored.withColumn("keep", F.col("score") >= threshold)


def keep_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of `docs` that `quality` keeps, with all their columns."""
    _, model = _fitted(docs, labels, id_col, text_col, lang_col, source_col, label_col)
    views = with_views(docs, docs.columns, text_col, lang_col, source_col)
    return _judged(views, model, threshold).filter("keep").select(*docs.columns)


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
