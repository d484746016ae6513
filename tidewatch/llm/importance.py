"""Target-distribution importance resampling on hashed word features.

Features are all runs of one and two words. A feature's bucket is the CRC-32 of its bytes modulo the
number of buckets. Buckets are counted over all documents and over all texts of the target, a bucket's
gain is the logarithm of the ratio of its two smoothed shares, a document's weight the mean gain of its features,
and the documents with the highest weights plus Gumbel noise (fixed by the document's id) are drawn: a sample
without replacement in proportion to the weights.

CRCs are taken of distinct features only, by length-bucketed matrices: the distinct features of a block of words
are grouped by equal length in bytes into two-dimensional uint8 arrays, the CRCs of all rows of an array are updated
column by column, and the buckets are scattered back to the features' occurrences.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewatch.llm.common import arrow_batches, materialise, query, ranked, table

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7
#: Words whose features are made distinct together, and rows of an Arrow batch.
BLOCK_WORDS, BATCH_ROWS = 1 << 18, 1000
#: Features longer than this many bytes are rows of their own, for which zlib's loop takes the place of ours.
WIDE = 1024

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return crc


_CRC = _crc_table()


def crc32_rows(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a uint8 matrix, all rows column by column."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = _CRC[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


class Words:
    """All words of a batch of texts: their bytes end to end, where each begins, and its text."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        folded = _FOLD[raw]
        inside = _IN_WORD[folded]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(raw))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        starts = np.flatnonzero(first)
        self.bytes = folded[inside]
        self.offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(np.flatnonzero(last) + 1 - starts, out=self.offsets[1:])
        self.text = np.searchsorted(offsets, starts, side="right") - 1
        self.n_texts = len(texts)

    def __len__(self) -> int:
        return len(self.text)


def _by_length(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places of that length)."""
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for places in np.split(order, cuts):
        if len(places):
            yield int(lengths[places[0]]), places


def _crc_of_features(
    data: np.ndarray, begin: np.ndarray, length: np.ndarray, second: np.ndarray, second_length: np.ndarray
) -> np.ndarray:
    """CRCs of features: one word each, or two (where second >= 0) with a blank between them."""
    paired = second >= 0
    total = length + np.where(paired, second_length + 1, 0)
    out = np.zeros(len(begin), np.uint32)
    for size, places in _by_length(total):
        if size > WIDE:
            for k in places:
                one = data[begin[k] : begin[k] + length[k]].tobytes()
                two = data[second[k] : second[k] + second_length[k]].tobytes()
                out[k] = zlib.crc32(one + b" " + two if paired[k] else one)
            continue
        at = np.arange(size)
        place = begin[places, None] + at
        after = at > length[places, None]
        place = np.where(after, second[places, None] + at - length[places, None] - 1, place)
        blank = at == length[places, None]
        matrix = data[np.where(blank, 0, place)]
        matrix[blank] = 32
        out[places] = crc32_rows(matrix)
    return out


def feature_buckets(words: Words, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every occurrence of every feature, a block of words at a time."""
    for at in range(0, len(words), BLOCK_WORDS):
        end = min(at + BLOCK_WORDS, len(words))
        upto = min(end + 1, len(words))  # the last word's pair may reach into the next block
        offsets = words.offsets[at : upto + 1]
        block = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), upto - at,
            [None, pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])),
             pa.py_buffer(words.bytes[offsets[0] : offsets[-1]])],
        ).dictionary_encode()
        index = block.indices.to_numpy().astype(np.int64)
        distinct = block.dictionary
        begin = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
        data = np.frombuffer(distinct.buffers()[2], np.uint8)
        length = np.diff(begin)
        text = words.text[at:upto]
        left = np.flatnonzero(text[:-1] == text[1:])
        pairs, pair_of = np.unique(index[left] * len(distinct) + index[left + 1], return_inverse=True)
        one, two = np.divmod(pairs, len(distinct))
        single = np.full(len(distinct), -1)
        crc = _crc_of_features(
            data,
            np.concatenate([begin[:-1], begin[one]]),
            np.concatenate([length, length[one]]),
            np.concatenate([single, begin[two]]),
            np.concatenate([single, length[two]]),
        )
        bucket = (crc % np.uint32(buckets)).astype(np.int64)
        yield text[: end - at], bucket[index[: end - at]]
        yield text[left], bucket[len(distinct) + pair_of]


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: occurrences of features over all texts; buckets without any are absent."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in feature_buckets(Words(batch.column(0)), buckets):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    partial = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of each bucket: floor(1000 * ln of the ratio of its add-one shares); `buckets` numbers on the driver."""

    def dense(counts: DataFrame) -> list[int]:
        out = [0] * buckets
        for r in counts.collect():  # one row for each bucket at most
            out[r["bucket"]] = r["n"]
        return out

    s, t = dense(source), dense(target)
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [
        math.floor(1000 * math.log(((b + 1.0) * all_s) / ((a + 1.0) * all_t))) for a, b in zip(s, t, strict=True)
    ]


def weighted(docs: DataFrame, text_col: str, gain: list[int]) -> DataFrame:
    """`docs` with __words, __features and __weight: the floored mean gain of a text's features, 0 without any."""
    at, buckets = docs.columns.index(text_col), len(gain)
    added = [StructField(c, LongType()) for c in ("__words", "__features", "__weight")]
    schema = StructType([*docs.schema.fields, *added])

    def weigh(batches):
        value = np.array(gain, np.float64)
        for batch in batches:
            words = Words(batch.column(at))
            n_words = np.bincount(words.text, minlength=words.n_texts)
            n, total = np.zeros(words.n_texts, np.int64), np.zeros(words.n_texts)
            for text, bucket in feature_buckets(words, buckets):
                n += np.bincount(text, minlength=words.n_texts)
                total += np.bincount(text, weights=value[bucket], minlength=words.n_texts)
            weight = total.astype(np.int64) // np.maximum(n, 1)  # sums of whole numbers, exact in doubles
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words.astype(np.int64)), pa.array(n), pa.array(weight)],
                [*batch.schema.names, "__words", "__features", "__weight"],
            )

    return docs.mapInArrow(weigh, schema)


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    with_text: bool = False,
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_features, weight, score, rank and, if asked for, text.

    `percent` % (floored) of the documents with at least `least_words` words are drawn: those of the highest scores, ties to the
    smaller id. rank numbers them from 1 in that order and is NULL for all others. NULL and empty texts
    have no features and weight 0. A NULL id takes its noise from the empty string and comes last among equal
    scores. Rows that repeat an id have the same noise and are ranked one by one. An empty table gives no rows; with an empty
    target every document is weighed against uniform shares. Other columns are ignored, so their
    names cannot clash.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    target = target.select(F.col(target_col).cast("string").alias("text"))
    with arrow_batches(spark, BATCH_ROWS):
        gain = gains(bucket_counts(docs, "text", buckets), bucket_counts(target, "text", buckets), buckets)
        weights = weighted(docs, "text", gain)
        digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
        uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
        noise = F.floor(-1000.0 * F.log(-F.log(uniform)))
        scored = weights.select(
            "doc_id",
            F.col("__words").alias("n_words"),
            F.col("__features").alias("n_features"),
            F.col("__weight").alias("weight"),
            (F.col("__weight") + noise).cast("long").alias("score"),
            *(["text"] if with_text else []),
        )
        scored = materialise(scored, "importance")
    enough = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * enough.count() // 100
    order = ranked(enough, [F.desc("score"), F.col("doc_id").asc_nulls_last()], "importance-ranks")
    order = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least_words)
    return order.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


_ORACLE = rf"""
    WITH words AS (
      SELECT false AS wanted, doc_id AS id,
             regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents
      UNION ALL
      SELECT true, item_id,
             regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
      FROM benchmark),
    feature AS MATERIALIZED (
      SELECT wanted, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f
      FROM words),
    crc AS MATERIALIZED (
      SELECT f, xor(4294967295, list_reduce(
          list_prepend(4294967295::BIGINT, flatten(list_transform(
            range(0, len(h) // 2),
            lambda i: [('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
          lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % {BUCKETS} AS bucket
      FROM (SELECT DISTINCT f, hex(f) AS h FROM feature)),
    counted AS (
      SELECT bucket, count(*) FILTER (NOT wanted) AS s, count(*) FILTER (wanted) AS t
      FROM feature JOIN crc USING (f) GROUP BY bucket),
    gain AS (
      SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE
             / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain
      FROM counted),
    weight AS (
      SELECT id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
      FROM feature JOIN crc USING (f) JOIN gain USING (bucket) WHERE NOT wanted GROUP BY id),
    score AS (
      SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln(
               (('0x' || substr(sha256('{SEED}:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM (SELECT * FROM words WHERE NOT wanted) LEFT JOIN weight USING (id)),
    place AS (
      SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
      FROM score WHERE n_words >= {LEAST_WORDS})
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank
    FROM score LEFT JOIN place USING (doc_id)
    """


@query("op12_importance_resample", _ORACLE)
def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draw over all documents towards the distribution of all benchmark texts."""
    drawn = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
