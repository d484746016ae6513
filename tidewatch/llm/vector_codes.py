"""Vector code compression: product codes with an equal-average search for the nearest entry.

A vector is cut into equal consecutive parts and each part is replaced by the number of the nearest
entry of its position's codebook. Codebooks are refined over rounds: Spark tasks assign their vectors and
add up one sum for each entry; the sums of all tasks are combined by a grouping, and the next codebook, whose
size does not depend on the input, goes to the driver and on to the tasks.

The nearest entry is searched by equal averages: entries are sorted by the sum of their components,
and for a part of dimension k the squared difference of the sums over k never exceeds the squared
distance (Cauchy-Schwarz). The search goes outward from the part's own sum, to the side with the smaller gap
first, and ends once that bound is strictly above the best distance; equal distances are still compared, so
ties go to the lower index. All parts of a batch take each step together, in integers throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewatch.llm.common import join_counted, materialise, query, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that are assigned at once in a task.
BLOCK = 4096


class Codebook:
    """Entries of one part position, sorted by the sum of their components."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.order = np.lexsort((np.arange(len(entries)), sums))
        self.entries = entries[self.order]
        self.sums = sums[self.order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part and its squared distance; ties to the lower index."""
        n, k = parts.shape
        best = np.full(n, np.iinfo(np.int64).max)
        index = np.zeros(n, np.int64)
        if not k:
            return index, np.zeros(n, np.int64)
        own = parts.sum(axis=1)
        last, far = len(self.sums), np.iinfo(np.int64).max
        above = np.searchsorted(self.sums, own)
        below = above - 1
        open_ = np.arange(n)
        while len(open_):
            up, down, mine = above[open_], below[open_], own[open_]
            gap_up = np.where(up < last, np.abs(self.sums[np.minimum(up, last - 1)] - mine), far)
            gap_down = np.where(down >= 0, np.abs(mine - self.sums[np.maximum(down, 0)]), far)
            upward = gap_up <= gap_down
            gap = np.where(upward, gap_up, gap_down)
            # gap * gap / k > best, in integers and without the first, unlimited, best
            found = best[open_] != far
            limit = np.where(found, best[open_], 0) * k
            going = (gap != far) & ~(found & (np.where(gap == far, 0, gap) ** 2 > limit))
            open_, upward = open_[going], upward[going]
            at = np.where(upward, above[open_], below[open_])
            difference = parts[open_] - self.entries[at]
            distance = np.einsum("ij,ij->i", difference, difference)
            better = (distance < best[open_]) | ((distance == best[open_]) & (self.order[at] < index[open_]))
            hit = open_[better]
            best[hit], index[hit] = distance[better], self.order[at][better]
            above[open_[upward]] += 1
            below[open_[~upward]] -= 1
        return index, best


def _assigned(vectors: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, one column for each part."""
    cut = vectors.reshape(len(vectors), len(books), -1).transpose(1, 0, 2)
    found = [book.nearest(np.ascontiguousarray(part)) for book, part in zip(books, cut, strict=True)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _matrices(column: pa.ChunkedArray | pa.Array, length: int) -> Iterator[np.ndarray]:
    for at in range(0, len(column), BLOCK):
        flat = column.slice(at, BLOCK).flatten().to_numpy(zero_copy_only=False)
        yield flat.reshape(-1, length).astype(np.int64, copy=False) if length else np.zeros(
            (min(BLOCK, len(column) - at), 0), np.int64
        )


def integer_vectors(rows: DataFrame, vector_col: str, parts: int, scale: int = SCALE) -> DataFrame:
    """`rows` without unusable vectors, and columns __whole (integers), __fits.

    A vector is unusable when it is NULL or holds a NULL or non-finite component. A vector fits when its length is
    the most frequent one (the smaller of equally frequent ones) and no component is so large
    that distances could leave 64 bits.
    """
    vector = F.col(vector_col).cast("array<double>")
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.filter(vector.isNotNull() & F.coalesce(ok, F.lit(False)))
    lengths = kept.groupBy(F.size(vector_col).alias("length")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), "length").limit(1).collect()
    length = common[0]["length"] if common else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components have no {parts} equal parts")
    bound = 2**30 // max(length, 1)
    fits = (F.size(vector_col) == length) & F.forall(vector, lambda x: F.abs(F.lit(float(scale)) * x) < bound)
    whole = F.when(fits, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x).cast("long")))
    return kept.select("*", whole.alias("__whole"), fits.alias("__fits"))


class VectorCodes:
    """Fitted codebooks of vectors of one length; `books` has one array (entries, length of a part) a part."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books

    @property
    def sha256(self) -> str:
        flat = (str(int(x)) for book in self.books for x in book.ravel())
        return hashlib.sha256(",".join(flat).encode()).hexdigest()

    def sums(self, whole: DataFrame) -> DataFrame:
        """part, entry, place, n, total: of the vectors nearest to an entry, their number and component sums."""
        books = self.books
        length = sum(b.shape[1] for b in books)

        def add(batches):
            sorted_books = [Codebook(b) for b in books]
            totals = [np.zeros(b.shape, np.int64) for b in books]
            counts = [np.zeros(len(b), np.int64) for b in books]
            for batch in batches:
                for vectors in _matrices(batch.column(0), length):
                    codes, _ = _assigned(vectors, sorted_books)
                    cut = vectors.reshape(len(vectors), len(books), -1)
                    for p in range(len(books)):
                        np.add.at(totals[p], codes[:, p], cut[:, p])
                        counts[p] += np.bincount(codes[:, p], minlength=len(counts[p]))
            for p, (total, count) in enumerate(zip(totals, counts, strict=True)):
                entry, place = (x.ravel() for x in np.indices(total.shape))
                used = count[entry] > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(used.sum(), p, np.int32)), pa.array(entry[used].astype(np.int32)),
                     pa.array(place[used].astype(np.int32)), pa.array(count[entry][used]),
                     pa.array(total.ravel()[used])],
                    ["part", "entry", "place", "n", "total"],
                )

        partial = whole.mapInArrow(add, "part int, entry int, place int, n long, total long")
        return partial.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    def refined(self, whole: DataFrame) -> VectorCodes:
        """Codebooks whose used entries are the floored means of their parts."""
        books = [b.copy() for b in self.books]
        for r in self.sums(whole).collect():  # as many numbers as the codebooks have
            books[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
        return VectorCodes(books)

    def encode(self, rows: DataFrame) -> DataFrame:
        """`rows`, whose last columns are __whole and __fits, with __code and __error in their place."""
        books = self.books
        length = sum(b.shape[1] for b in books)
        at = len(rows.columns) - 2
        added = [StructField("__code", StringType()), StructField("__error", LongType())]
        schema = StructType([*rows.schema.fields[:-2], *added])

        def code(batches):
            sorted_books = [Codebook(b) for b in books]
            for batch in batches:
                column = batch.column(at)
                fits = np.asarray(column.is_valid())
                codes, errors = np.zeros((0, len(books)), np.int64), np.zeros((0, len(books)), np.int64)
                for vectors in _matrices(column.drop_null(), length):
                    more = _assigned(vectors, sorted_books)
                    codes, errors = np.concatenate([codes, more[0]]), np.concatenate([errors, more[1]])
                digits = max([2, *(len(f"{len(b) - 1:x}") for b in books)])
                texts = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
                out_code = np.full(len(fits), None, object)
                out_error = np.full(len(fits), None, object)
                out_code[fits], out_error[fits] = texts, errors.sum(axis=1).tolist()
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:at], pa.array(out_code, pa.string()), pa.array(out_error, pa.int64())],
                    [*batch.schema.names[:at], "__code", "__error"],
                )

        return rows.mapInArrow(code, schema)


def fit_vector_codes(
    whole: DataFrame, id_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> VectorCodes:
    """Codebooks of `whole` (columns `id_col`, __whole): the vectors of the smallest ids, then `rounds` refinements.

    The start takes `entries` rows to the driver; each round takes entries x length sums.
    """
    first = whole.filter("__whole is not null").orderBy(F.col(id_col).asc_nulls_last(), "__whole").limit(entries)
    rows = [r["__whole"] for r in first.collect()]
    start = np.array(rows, np.int64).reshape(len(rows), parts, -1) if rows else np.zeros((0, parts, 0), np.int64)
    codes = VectorCodes([np.ascontiguousarray(start[:, p]) for p in range(parts)])
    vectors = whole.filter("__whole is not null").select("__whole")
    for _ in range(rounds if rows else 0):
        codes = codes.refined(vectors)
    return codes


def compress(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row for each usable vector: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is NULL or holds a NULL or non-finite component give no row. Of several lengths the most
    frequent is coded (the smaller of equally frequent ones); a vector of another length, or with a component
    beyond 2^30 / (1024 * length) in size, keeps its row with NULL code and error. Vectors without components
    have code 0 and error 0. NULL ids come after all others when the start is chosen, rows that repeat an id in order of
    their components; each repeated row is coded. With fewer rows than entries the codebook is smaller. NULL labels
    are one group; a sum that leaves 64 bits is NULL. A length without `parts` equal parts raises. An empty table
    gives no rows. Other columns are ignored, so their names cannot clash.
    """
    rows = rows.select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).alias("__vector"), F.col(label_col).alias("__label")
    )
    whole = integer_vectors(rows, "__vector", parts).drop("__vector")
    codes = fit_vector_codes(whole, "vec_id", parts, entries, rounds)
    coded = materialise(codes.encode(whole.select("vec_id", "__label", "__whole", "__fits")), "vector-codes")
    coded = coded.withColumn("__label", F.md5(F.to_json(F.struct("__label"))))
    labels = coded.groupBy("__label").agg(F.try_sum("__error").alias("label_error"))
    return join_counted(coded, materialise(labels, "label-errors"), "__label").select(
        "vec_id", F.col("__code").alias("code"), F.col("__error").alias("error"), "label_error",
        F.lit(codes.sha256).alias("codebooks_sha256"),
    )


def _oracle() -> str:
    """The rounds as one common table expression each; `d` holds every part of every vector as integers."""
    distance = "list_sum(list_transform(list_zip(d.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def nearest(r: int) -> str:
        return f"""
    a{r} AS (
      SELECT row, part, min_by(entry, (dist, entry)) AS entry, min(dist) AS dist
      FROM (SELECT d.row, d.part, c.entry, {distance} AS dist FROM d JOIN c{r} c USING (part))
      GROUP BY row, part)"""

    def mean(r: int) -> str:
        return f"""
    s{r} AS (
      SELECT part, entry, place, sum(x)::BIGINT AS total, count(*) AS n
      FROM (SELECT a.part, a.entry, unnest(range(1, len(d.v) + 1)) AS place, unnest(d.v) AS x
            FROM a{r} a JOIN d USING (row, part))
      GROUP BY ALL),
    m{r} AS (
      SELECT part, entry, list((total - ((total % n) + n) % n) // n ORDER BY place) AS v FROM s{r} GROUP BY ALL),
    c{r + 1} AS (
      SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (part, entry))"""

    rounds = ",".join(f"{nearest(r)},{mean(r)}" for r in range(ROUNDS))
    return f"""
    WITH k AS MATERIALIZED (
      SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row,
             list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS w
      FROM embeddings
      WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    d AS MATERIALIZED (
      SELECT row, part, w[part * len(w) // {PARTS} + 1 : (part + 1) * len(w) // {PARTS}] AS v
      FROM k, (SELECT unnest(range({PARTS})) AS part)),
    c0 AS (SELECT part, row - 1 AS entry, v FROM d WHERE row <= {ENTRIES}),{rounds},{nearest(ROUNDS)},
    h AS (
      SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256
      FROM c{ROUNDS}),
    e AS (
      SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error
      FROM a{ROUNDS} GROUP BY row)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM e JOIN k USING (row), h
    """


@query("op13_vector_codes", _oracle())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))
