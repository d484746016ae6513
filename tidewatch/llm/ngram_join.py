"""Near duplicates by the Jaccard similarity of word shingles: prefix keys and signature trees.

1. Every text becomes its set of shingle hashes; equal sets are one class (`set_id`, a 64-bit
   hash of the set), so exact copies meet nowhere below.
2. All shingles have one order: those that are frequent last, then those of frequent words, then by
   hash; sketches of all documents, of a fixed number of cells, say how frequent. Two linked sets share a
   key among their first n - ceil(0.8 n) + 1, so blocks of equal keys hold every linked pair.
3. Joining round: blocks of the FIRST_KEYS least hashes, large ones in chunks that share one
   set. Within a chunk a signature tree gives candidates, exact sets decide, and only
   links between what is not yet connected are looked at: groups of copies cost their size, not its square.
4. Closing round: blocks of all keys, as far as they hold more than one component. Sizes, the places of the
   shared key and the bitmaps, in signature trees where the block is large, give the pairs that may link
   two components; those are decided exactly, the most similar of each two components first, the
   rest only where these are still apart.

Nothing is skipped: a pair is left undecided only if its documents are already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.llm import signature_tree
from tidewatch.llm.common import arrow_batches, giving_back, materialise, query, release, table
from tidewatch.llm.components import connected_components
from tidewatch.llm.shingles import PERCENT, WIDTH, blocks, linked, shingle_sets

SKETCH_BITS, WORD_BITS = 20, 16
#: A task reports a cell that holds more than this, plus 4 times its mean cell.
SKETCH_FLOOR = 8
FIRST_KEYS = 2
#: Sets, and shingles, of a chunk of a large block.
CHUNK_SETS, CHUNK_SHINGLES = 1024, 2_000_000
#: Documents up to which a list of ids is broadcast (16 bytes each); longer lists are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Sets of a block whose pairs are listed as they are; larger blocks go through signature trees.
SMALL_BLOCK = 32
#: Texts whose sets a task holds at once.
ROWS_AT_ONCE = 256
#: Rows of an Arrow batch: texts, sets and bitmaps are large.
BATCH_ROWS = 1000
#: Rows of one key that a task holds at once.
HELD_ROWS = 2048


def _texts(batches: Iterator[pa.RecordBatch]):
    """Batches of at most ROWS_AT_ONCE rows, and their texts."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(start, ROWS_AT_ONCE)
            yield batch, batch.column(batch.schema.get_field_index("text"))


def _signed(number: int) -> int:
    return number - (1 << 64) if number >= 1 << 63 else number


def _set_id(found: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(found.tobytes()))


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


_FIRST = ["doc_id", "n", "set_id", "words", "cell", "count"]


def _sets(width: int, id_type: pa.DataType):
    """Per document n and set_id; per task its words by cell, and the cells of its frequent shingles."""

    def tallies(counts, cells, words):
        none = pa.nulls(len(cells), pa.int64())
        columns = [
            pa.nulls(len(cells), id_type),
            none,
            none,
            pa.array([words] * len(cells), pa.bool_()),
            pa.array(cells, pa.int32()),
            pa.array(counts[cells], pa.int64()),
        ]
        return pa.record_batch(columns, _FIRST)

    def run(batches):
        shingles, words = np.zeros(1 << SKETCH_BITS, np.int64), np.zeros(1 << WORD_BITS, np.int64)
        for batch, texts in _texts(batches):
            sets = []
            for _, hashes, _ in blocks(texts):
                words += np.bincount(_cells(hashes, WORD_BITS), minlength=len(words))
            for found, _ in shingle_sets(texts, width):
                sets.append((len(found), _set_id(found)))
                np.add.at(shingles, _cells(found, SKETCH_BITS), 1)
            columns = [
                batch.column(0),
                pa.array([n for n, _ in sets], pa.int64()),
                pa.array([i for _, i in sets], pa.int64()),
                pa.nulls(len(sets), pa.bool_()),
                pa.nulls(len(sets), pa.int32()),
                pa.nulls(len(sets), pa.int64()),
            ]
            yield pa.record_batch(columns, _FIRST)
        yield tallies(words, np.nonzero(words)[0], True)
        yield tallies(shingles, np.nonzero(shingles > SKETCH_FLOOR + 4 * shingles.mean())[0], False)

    return run


def _prefixes(order, width: int, percent: int):
    """Once for each set and task: keys of both rounds, and the bitmap.

    `first` has the FIRST_KEYS least hashes, `keys` the prefix in the common order: frequent
    shingles last, then those of frequent words, then by hash.
    """

    def run(batches):
        seen, (levels, weights) = set(), order.value
        for _, texts in _texts(batches):
            rows = []
            for found, heavy in shingle_sets(texts, width, weights):
                set_id = _set_id(found)
                if not len(found) or set_id in seen:
                    continue
                seen.add(set_id)
                n = len(found)
                level = levels[_cells(found, SKETCH_BITS)]
                place = np.lexsort((found, heavy, level))[: n - -(-percent * n // 100) + 1]
                rows.append(
                    (
                        set_id,
                        n,
                        found[:FIRST_KEYS].copy().view(np.int64),
                        found[place].view(np.int64),
                        signature_tree.bitmap(found).tobytes(),
                    )
                )
            ids, sizes, first, keys, maps = zip(*rows) if rows else ((), (), (), (), ())
            columns = [
                pa.array(ids, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(list(first), pa.list_(pa.int64())),
                pa.array(list(keys), pa.list_(pa.int64())),
                pa.array(maps, pa.binary()),
            ]
            yield pa.record_batch(columns, ["set_id", "n", "first", "keys", "bitmap"])

    return run


def _hashes(width: int):
    """The set of each wanted document, once for each set and task."""

    def run(batches):
        seen = set()
        for batch, texts in _texts(batches):
            wanted = batch.column(batch.schema.get_field_index("set_id")).to_pylist()
            at, sets = [], []
            for i, (found, _) in enumerate(shingle_sets(texts, width)):
                if wanted[i] not in seen and _set_id(found) == wanted[i]:  # other rows may share the id
                    seen.add(wanted[i])
                    at.append(i)
                    sets.append(found.view(np.int64))
            kept = batch.take(pa.array(at, pa.int64())).drop_columns(["text"])
            yield kept.append_column("hashes", pa.array(sets, pa.list_(pa.int64())))

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]):
    """One table for each run of equal keys, of sorted input."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        columns = [part.column(k).to_numpy() for k in keys]
        change = np.zeros(part.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.nonzero(change)[0].tolist(), part.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(part.slice(start, end - start))
            last = key
    if held:
        yield pa.concat_tables(held)


def _joined(percent: int):
    """Links that connect the sets of each chunk, none between sets that are connected already."""

    def run(batches):
        for rows in _runs(batches, ["key", "chunk"]):
            ids, at = np.unique(rows.column("set_id").to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            column = rows.column("hashes")
            sets = [column[int(i)].values.to_numpy().view(np.uint64) for i in at]
            sizes = np.array([len(s) for s in sets])
            maps = [signature_tree.bitmap(s) for s in sets]
            group, found = np.arange(len(ids)), []
            for members, tree in signature_tree.size_classes(sizes, maps, percent):
                where = members[tree.order]
                for i, j in tree.leaf_pairs():
                    a, b, _ = tree.candidates(i, j)
                    a, b = where[a], where[b]
                    while len(a):
                        apart = group[a] != group[b]
                        a, b = a[apart], b[apart]
                        tried = 0
                        for x, y in zip(a, b):
                            tried += 1
                            if linked(sets[x], sets[y], percent):
                                found.append((ids[x], ids[y]))
                                group[group == group[y]] = group[x]
                                break
                        a, b = a[tried:], b[tried:]
            if found:
                columns = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]
                yield pa.record_batch(columns, ["a", "b"])

    return run


_MEETING = "key long, a long, b long, n_a long, n_b long, label_a long, label_b long"


def _feasible(n, place, percent: int):
    """Matrix of pairs whose sizes, and places of the shared key, allow a link.

    Of two linked sets' common keys take the first: nothing before it is common, so they share at
    most what follows it. At other common keys a pair may fail here, at that one it can't.
    """
    needed = signature_tree.needed(n[:, None], n[None, :], percent)
    after = n - place
    most = np.minimum(after[:, None], after[None, :])
    return np.minimum(most, np.minimum(n[:, None], n[None, :])) >= needed


def _meetings(percent: int):
    """From postings sorted by key: pairs from different components in blocks of up to SMALL_BLOCK
    sets, members of larger blocks. Of a block of any size only HELD_ROWS rows are held.

    A posting is key, set_id, label (NULL: its own component) and 2**32 n + place.
    """

    def small(key, ids, label, n, place):
        if len(ids) > HELD_ROWS // 2:
            return key, ids, None, n, None, label, None
        many = len(ids) > SMALL_BLOCK
        good = _feasible(n, place, percent) & (label[:, None] != label[None, :])
        if many:
            at = np.nonzero(good.any(axis=1))[0]
            return key, ids[at], None, n[at], None, label[at], None
        a, b = np.nonzero(np.triu(good, 1))
        return key, ids[a], ids[b], n[a], n[b], label[a], label[b]

    def rows(found):
        out = []
        for key, a, b, n_a, n_b, l_a, l_b in found:
            none = pa.nulls(len(a), pa.int64())
            columns = [np.full(len(a), key), a, b, n_a, n_b, l_a, l_b]
            columns = [none if c is None else pa.array(c.astype(np.int64)) for c in columns]
            out.append(pa.record_batch(columns, [c.split()[0] for c in _MEETING.split(", ")]))
        return pa.Table.from_batches(out).combine_chunks().to_batches() if out else []

    def run(batches):
        held, large = None, None  # rows of the last key so far; a key whose block is large
        for batch in batches:
            own, at = batch.column(1), batch.column(3).to_numpy()
            label = pc.coalesce(batch.column(2), own).to_numpy(zero_copy_only=False)
            now = [batch.column(0).to_numpy(), own.to_numpy(), label, at >> 32, at & 0xFFFFFFFF]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            found = []
            if large is not None and (more := now[0] == large).any():
                found.append((large, now[1][more], None, now[3][more], None, now[2][more], None))
                now = [c[~more] for c in now]
            key, ids, label, n, place = now
            if not len(key):
                yield from rows(found)
                continue
            cuts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
            tail = cuts[-1]
            sizes = np.diff(cuts)
            two = cuts[:-1][sizes == 2]
            if len(two):
                x, y = two, two + 1
                needed = signature_tree.needed(n[x], n[y], percent)
                most = np.minimum(np.minimum(n[x] - place[x], n[y] - place[y]), np.minimum(n[x], n[y]))
                good = (label[x] != label[y]) & (most >= needed)
                x, y = x[good], y[good]
                found.append((0, ids[x], ids[y], n[x], n[y], label[x], label[y]))
            for start, size in zip(cuts[:-1][sizes > 2], sizes[sizes > 2]):
                at = slice(start, start + size)
                if (label[at] != label[start]).any():
                    found.append(small(key[start], ids[at], label[at], n[at], place[at]))
            held = [c[tail:] for c in now]
            if len(held[0]) > HELD_ROWS:
                large = held[0][0]
                found.append((large, held[1], None, held[3], None, held[2], None))
                held = [c[:0] for c in now]
            yield from rows(found)
        if held is not None and len(held[0]) > 1:
            key, ids, label, n, place = held
            yield from rows([small(key[0], ids, label, n, place)])

    return run


_PAIR = "a long, b long, n_a long, n_b long, label_a long, label_b long, most double"


def _pairs(ids_a, ids_b, n_a, n_b, label_a, label_b, most) -> pa.RecordBatch:
    swap = ids_a > ids_b
    a, b, n_a, n_b, label_a, label_b = (
        np.where(swap, x, y)
        for x, y in (
            (ids_b, ids_a), (ids_a, ids_b), (n_b, n_a), (n_a, n_b), (label_b, label_a), (label_a, label_b)
        )
    )
    names = [c.split()[0] for c in _PAIR.split(", ")]
    return pa.record_batch([pa.array(c) for c in (a, b, n_a, n_b, label_a, label_b, most)], names)


def _bounded(percent: int):
    """Pairs with both bitmaps: those that pass the bound, and the similarity it allows."""

    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            maps = zip(get("map_a").to_pylist(), get("map_b").to_pylist())
            numbers = [get(c).to_numpy() for c in ("a", "b", "n_a", "n_b", "label_a", "label_b")]
            n_a, n_b = numbers[2], numbers[3]
            most = np.zeros(len(n_a), np.int64)
            for k, pair in enumerate(maps):
                x, y = (np.frombuffer(m, np.uint64) for m in pair)
                x, y = (signature_tree.folded(m, min(len(x), len(y))) for m in (x, y))
                lacks_x, lacks_y = np.bitwise_count(x & ~y).sum(), np.bitwise_count(y & ~x).sum()
                most[k] = min(n_a[k] - int(lacks_x), n_b[k] - int(lacks_y))
            good = most >= signature_tree.needed(n_a, n_b, percent)
            numbers = [c[good] for c in numbers]
            yield _pairs(*numbers, (most / (n_a + n_b - most))[good])

    return run


def _contested(percent: int):
    """Blocks with bitmaps: pairs of sets from two components that pass the bound.

    Sets that share several large blocks are a pair in the one of the least key only.
    """

    def run(batches):
        for rows in _runs(batches, ["key", "part"]):
            ids, at = np.unique(rows.column("set_id").to_numpy(), return_index=True)
            sizes, label, side = (rows.column(c).to_numpy()[at] for c in ("n", "label", "side"))
            bitmaps = rows.column("bitmap").take(pa.array(at))
            maps = [np.frombuffer(b, np.uint64) for b in bitmaps.to_pylist()]
            key = rows.column("key")[0].as_py()
            sooner = [
                {k for k in keys if k < key} for keys in rows.column("large").take(pa.array(at)).to_pylist()
            ]
            for a, b, most in signature_tree.similar_pairs(sizes, maps, label, percent):
                here = np.fromiter((sooner[x].isdisjoint(sooner[y]) for x, y in zip(a, b)), bool, len(a))
                a, b, most = a[here], b[here], most[here]
                if side.any() and not side.all():  # two chunks of a large block
                    across = side[a] != side[b]
                    a, b, most = a[across], b[across], most[across]
                yield _pairs(ids[a], ids[b], sizes[a], sizes[b], label[a], label[b], most)

    return run


class _Exact:
    """Decides pairs by their whole sets, which are made anew from the texts concerned."""

    def __init__(self, rows: DataFrame, classes: DataFrame, width: int, percent: int):
        self.rows, self.classes, self.width, self.percent = rows, classes, width, percent

    def _sets_of(self, wanted: DataFrame) -> DataFrame:
        """wanted: set_id and other columns. The same with `hashes`."""
        wanted = materialise(
            wanted.join(self.classes.select("set_id", F.col("least").alias("of")), "set_id"),
            "ngram-wanted",
        )
        few = wanted.count() <= BROADCAST_IDS
        texts = self.rows.join(
            F.broadcast(wanted) if few else wanted, self.rows.doc_id.eqNullSafe(F.col("of"))
        ).drop("doc_id", "of")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
        return texts.mapInArrow(giving_back(_hashes(self.width)), schema + ", hashes array<long>")

    def links_in_blocks(self, blocks: DataFrame) -> DataFrame:
        """blocks: key, chunk, set_id. Links that connect each chunk."""
        wanted = blocks.groupBy("set_id").agg(F.collect_list(F.struct("key", "chunk")).alias("places"))
        placed = self._sets_of(wanted).select(F.explode("places").alias("place"), "set_id", "hashes")
        chunks = (
            placed.select("place.key", "place.chunk", "set_id", "hashes")
            .repartition("key", "chunk")
            .sortWithinPartitions("key", "chunk")
        )
        return materialise(chunks.mapInArrow(giving_back(_joined(self.percent)), "a long, b long"), "ngram-links")

    def links_of_pairs(self, pairs: DataFrame) -> DataFrame:
        """Those of `pairs` (a, b, n_a, n_b, …) whose sets are similar enough."""
        ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
        sets = self._sets_of(ids).dropDuplicates(["set_id"])
        both = (
            pairs.join(sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("x")), "a")
            .join(sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("y")), "b")
            .withColumn("common", F.size(F.array_intersect("x", "y")))
            .drop("x", "y")
        )
        union = F.col("n_a") + F.col("n_b") - F.col("common")
        good = both.filter(100 * F.col("common") >= self.percent * union)
        return materialise(good.drop("common"), "ngram-links")


def _first_blocks(prefixes: DataFrame) -> DataFrame:
    """key, chunk, set_id: each set at the first of its least hashes that another set shares.

    The sets of a large block are dealt to chunks; its least set is in each, so that chunks of one
    group of copies connect.
    """
    postings = prefixes.select("set_id", "n", F.posexplode("first").alias("place", "key"))
    share = F.greatest(F.count("*") / CHUNK_SETS, F.sum("n") / CHUNK_SHINGLES)
    shared = (
        postings.groupBy("key")
        .agg(
            F.min("set_id").alias("least"),
            F.max("set_id").alias("last"),
            F.ceil(share).cast("long").alias("chunks"),
        )
        .filter("least < last")
    )
    best = F.min(F.struct("place", "key", "least", "chunks")).alias("best")
    block = postings.join(shared, "key").groupBy("set_id").agg(best).select("set_id", "best.*")
    chunk = F.pmod(F.xxhash64("set_id"), F.col("chunks"))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    places = F.when(F.col("set_id") == F.col("least"), everywhere).otherwise(F.array(chunk))
    return block.select("key", F.explode(places).alias("chunk"), "set_id")


def _members(met: DataFrame) -> DataFrame:
    """key, set_id of the large blocks that hold more than one component; the others have no pair to decide."""
    members = met.filter("b is null")
    mixed = members.groupBy("key").agg(F.min("label_a").alias("least"), F.max("label_a").alias("last"))
    mixed = mixed.filter("least < last").select("key")
    return members.join(mixed, "key").select("key", F.col("a").alias("set_id")).distinct()


def _contested_pairs(prefixes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets from different components that share a key and pass the signature bound.

    `prefixes` is released.
    """
    few = labels.count() <= BROADCAST_IDS
    labels = labels.withColumnRenamed("node", "set_id")
    labelled = prefixes.join(F.broadcast(labels) if few else labels, "set_id", "left").withColumn(
        "label", F.coalesce("label", "set_id")
    )
    # As few bytes as will do: of all that is shuffled here, this is the most.
    postings = labelled.select(
        "set_id",
        F.when(F.col("label") != F.col("set_id"), F.col("label")).alias("label"),
        F.shiftleft("n", 32).alias("n"),
        F.posexplode("keys").alias("place", "key"),
    ).select("key", "set_id", "label", (F.col("n") + F.col("place")).alias("at"))
    postings = postings.repartition("key").sortWithinPartitions("key")
    met = materialise(postings.mapInArrow(giving_back(_meetings(percent)), _MEETING), "ngram-meetings")
    pair = ["a", "b", "n_a", "n_b", "label_a", "label_b"]
    near = materialise(met.filter("b is not null").select(pair).distinct(), "ngram-near")
    members = materialise(_members(met), "ngram-members")
    release(met)

    ids = members.select("set_id").union(near.select("a")).union(near.select("b")).distinct()
    ids = materialise(ids, "ngram-ids")
    few = ids.count() <= BROADCAST_IDS
    payload = materialise(
        labelled.join(F.broadcast(ids) if few else ids, "set_id")
        .groupBy("set_id")
        .agg(*(F.first(c).alias(c) for c in ("n", "label", "bitmap"))),
        "ngram-payload",
    )
    release(prefixes, ids)
    maps = [payload.select(F.col("set_id").alias(c), F.col("bitmap").alias(f"map_{c}")) for c in "ab"]
    small = near.join(maps[0], "a").join(maps[1], "b").mapInArrow(giving_back(_bounded(percent)), _PAIR)

    chunks = members.groupBy("key").agg(F.ceil(F.count("*") / CHUNK_SETS).cast("long").alias("chunks"))
    places = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    placed = (
        members.join(chunks, "key")
        .withColumn("chunk", F.pmod(F.xxhash64("set_id"), F.col("chunks")))
        .withColumn("other", F.explode(places))
        .select(
            "key",
            (F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other")).alias("part"),
            (F.col("chunk") > F.col("other")).cast("int").alias("side"),
            "set_id",
        )
        .join(payload, "set_id")
        .join(members.groupBy("set_id").agg(F.collect_set("key").alias("large")), "set_id")
        .repartition("key", "part")
        .sortWithinPartitions("key", "part")
    )
    large = placed.mapInArrow(giving_back(_contested(percent)), _PAIR)
    pairs = small.union(large).groupBy(*pair).agg(F.first("most").alias("most"))
    pairs = materialise(pairs, "ngram-contested")
    release(near, members, payload)
    return pairs


def _logs(first: DataFrame, words: bool, bits: int) -> np.ndarray:
    """1 + the whole logarithm of each cell's count: at most 2**bits short rows come to the driver."""
    counts = (
        first.filter((F.col("words") == words) & F.col("cell").isNotNull())
        .groupBy("cell")
        .agg(F.sum("count").alias("count"))
        .toArrow()
    )
    logs = np.zeros(1 << bits, np.uint8)
    logs[counts["cell"].to_numpy()] = 1 + np.log2(counts["count"].to_numpy()).astype(np.uint8)
    return logs


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id. All but the last join runs at once.

    A document is the set of its `width`-word shingles; two are linked when 100 * intersection >=
    percent * union. component_id is the least id that links lead to, the row itself included.
    NULL, empty and blank texts have no shingles and no links, not even with each other. A text with
    fewer words is one shingle. Copies, also repeated rows, are linked. A NULL id is linked like any
    other and never the least, unless it is alone. Other columns are ignored; an empty table gives
    no rows. Sets and shingles are told apart by 64 bits of a hash.
    """
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return _grouped(docs, id_col, text_col, width, percent)


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType
    first = materialise(
        rows.mapInArrow(
            giving_back(_sets(width, to_arrow_type(id_type))),
            f"doc_id {id_type.simpleString()}, n long, set_id long, words boolean, cell int, count long",
        ),
        "ngram-sets",
    )
    documents = first.filter("cell is null").select("doc_id", "n", "set_id")
    classes = materialise(
        documents.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least")),
        "ngram-classes",
    )
    order = spark.sparkContext.broadcast((_logs(first, False, SKETCH_BITS), _logs(first, True, WORD_BITS)))
    prefixes = materialise(
        rows.mapInArrow(
            giving_back(_prefixes(order, width, percent)),
            "set_id long, n long, first array<long>, keys array<long>, bitmap binary",
        ),
        "ngram-prefixes",
    )
    exact = _Exact(rows, classes, width, percent)
    labels = connected_components(exact.links_in_blocks(_first_blocks(prefixes)))

    pairs = _contested_pairs(prefixes, labels, percent)
    edges = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    ends = (F.least("label_a", "label_b"), F.greatest("label_a", "label_b"))
    best = pairs.groupBy(*ends).agg(F.max(F.struct("most", "a", "b", "n_a", "n_b")).alias("best"))
    sooner = materialise(best.select("best.*"), "ngram-sooner")
    if not sooner.isEmpty():
        edges = edges.union(exact.links_of_pairs(sooner).select("a", "b"))
        labels = connected_components(edges)
        now = [labels.select(F.col("node").alias(c), F.col("label").alias(f"now_{c}")) for c in "ab"]
        apart = F.coalesce("now_a", "a") != F.coalesce("now_b", "b")
        later = pairs.join(sooner, ["a", "b"], "left_anti").join(now[0], "a", "left").join(now[1], "b", "left")
        later = materialise(later.filter(apart).select("a", "b", "n_a", "n_b"), "ngram-later")
        if not later.isEmpty():
            edges = edges.union(exact.links_of_pairs(later).select("a", "b"))
            labels = connected_components(edges)

    joined = classes.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "label", F.coalesce("label", "set_id")
    )
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    component = joined.join(least, "label").select("set_id", "component_id")
    return documents.join(component, "set_id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


@query("op1_ngram_jaccard_join")
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
