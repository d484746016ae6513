"""Packing into sequences: bounded-space online best fit, then merging of what is left open.

Each task keeps OPEN windows. A document is cut into whole sequences as long as it is longer than one; the rest
goes to the open window with the least sufficient room. When none has room, the fullest is emitted and
a new one opened. What is open at the end of a task is merged: the pieces of MERGED tasks' windows are
packed again, largest first, level by level, until one task has seen the last open windows. What is far
from full even then is cut into whole sequences, and the rest of that at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.llm.common import TEXT_ROWS, arrow_batches, giving_back, materialise, query, table
from tidewatch.llm.tokens import Vocabulary, encode, public_vocabulary

LENGTH, OPEN = 2048, 64
#: Tasks, or groups of them, whose open windows are merged in one group.
MERGED = 32
#: A window with less room than this part of its length is full enough to be emitted when merging.
FULL = 1 / 64
#: Added to each document's ids.
END_ID = 1

_FIELDS = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "open"]


class Windows:
    """A fixed number of open windows, found by their room."""

    def __init__(self, length: int, n: int):
        self.length, self.n = length, n
        self.room: list[tuple[int, int]] = []  # sorted (room, window)
        self.made = 0

    def place(self, size: int) -> tuple[int, int, int | None]:
        """(window, offset in it, window emitted for want of room or None)."""
        at = bisect_left(self.room, (size, -1))
        emitted = None
        if at < len(self.room):
            room, window = self.room.pop(at)
        else:
            if len(self.room) == self.n:
                _, emitted = self.room.pop(0)  # least room: the fullest
            room, window = self.length, self.made
            self.made += 1
        insort(self.room, (room - size, window))
        return window, self.length - room, emitted


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
    return pa.record_batch(columns, _FIELDS)


def _packed(dtype: str, length: int, n_open: int, end_id: int, id_type: pa.DataType):
    """Pieces of closed sequences, and of windows still open (`open`: the task's number)."""
    width = int(dtype[-1])
    end = np.array([end_id], dtype).tobytes()

    def run(batches):
        task = TaskContext.get().partitionId()
        base, whole = task << 36, 0
        windows, held = Windows(length, n_open), {}
        for batch in batches:
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = ids + end
                tokens = len(ids) // width
                for start in range(0, tokens - length + 1, length):
                    part = ids[start * width : (start + length) * width]
                    out.append((doc, start, part, tokens, base | 1 << 35 | whole, 0, None))
                    whole += 1
                start = tokens // length * length
                if start == tokens:
                    continue
                window, offset, emitted = windows.place(tokens - start)
                if emitted is not None:
                    out += [(*piece, None) for piece in held.pop(emitted)]
                piece = (doc, start, ids[start * width :], tokens, base | window, offset)
                held.setdefault(window, []).append(piece)
            yield _batch(out, id_type)
        full = [w for room, w in windows.room if room == 0]
        yield _batch([(*piece, None) for w in full for piece in held.pop(w)], id_type)
        for pieces in held.values():
            yield _batch([(*piece, task) for piece in pieces], id_type)

    return run


def _merged(dtype: str, length: int, level: int, last: bool, id_type: pa.DataType):
    """Pieces of a group of open windows, packed again, largest first."""
    width = int(dtype[-1])

    def cut(pieces, base, made):
        """The pieces one after the other, cut into whole sequences, and their rest at powers of two,
        largest first, so that nothing is padded."""

        def next_size(left):
            return min(length, 1 << (left.bit_length() - 1)) if left < length else length

        out, left = [], sum(len(p[2]) for p in pieces) // width
        size, offset = next_size(left), 0
        for doc, start, ids, tokens in pieces:
            while ids:
                part = ids[: (size - offset) * width]
                out.append((doc, start, part, tokens, base | made, offset, None))
                n = len(part) // width
                ids, start, offset, left = ids[len(part) :], start + n, offset + n, left - n
                if offset == size and left:
                    size, offset, made = next_size(left), 0, made + 1
        return out

    def run(key, rows):
        group = key[0].as_py()
        base = 1 << 62 | level << 56 | group << 24
        columns = [rows.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]
        pieces = sorted(zip(*columns), key=lambda p: (-len(p[2]), p[0] is None, p[0] or 0, p[1]))
        windows, held = Windows(length, len(pieces) + 1), {}
        for piece in pieces:
            window, offset, _ = windows.place(len(piece[2]) // width)
            held.setdefault(window, []).append((piece, offset))
        out, loose = [], []
        for room, window in windows.room:
            if last and room > length * FULL:
                loose += [p for p, _ in held[window]]
            else:
                stays = group // MERGED if room > length * FULL else None
                out += [(*p, base | window, offset, stays) for p, offset in held[window]]
        out += cut(loose, base, windows.made) if loose else []
        return pa.Table.from_batches([_batch(out, id_type)])

    return run


def pack(
    docs: DataFrame,
    path: str,
    length: int = LENGTH,
    n_open: int = OPEN,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, ids, doc_tokens, sequence_id, offset.

    A document is its text's token ids and then `end_id`; `ids` holds a piece's, little-endian unsigned with
    Vocabulary(path).id_bytes bytes each. start counts the document's ids before the piece, offset the
    sequence's. Every id is in exactly one piece; no sequence is longer than `length`. NULL and empty texts are `end_id` alone. Long texts fill
    sequences of their own as far as they go. Repeated rows and NULL ids are documents like any
    other; an empty table gives no rows; other columns are ignored.
    """
    encoded = encode(docs, path, id_col, text_col)
    dtype, kind = Vocabulary(path).dtype, encoded.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    schema = (
        f"doc_id {kind.simpleString()}, start long, ids binary, doc_tokens long, "
        "sequence_id long, offset long, open int"
    )
    # Written once: both kinds of rows must come from the same run of the packing tasks.
    packed = giving_back(_packed(dtype, length, n_open, end_id, arrow))
    with arrow_batches(docs.sparkSession, TEXT_ROWS):
        pieces = materialise(encoded.mapInArrow(packed, schema), "packed")
    closed = pieces.filter("open is null")
    left = pieces.filter("open is not null").withColumn("group", F.expr(f"open div {MERGED}").cast("long"))
    level = 0
    while True:
        groups = left.select("group").distinct().count()
        last = groups <= 1
        merged = left.groupBy("group").applyInArrow(_merged(dtype, length, level, last, arrow), schema)
        if last:
            return closed.union(merged).drop("open")
        merged = materialise(merged, "packed-merged")
        closed = closed.union(merged.filter("open is null"))
        left = merged.filter("open is not null").withColumn("group", F.col("open").cast("long"))
        level += 1


def _checksums(width: int):
    """length and ids_crc32 (of unsigned 32-bit ids) of each piece."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            sums, lengths = [], []
            for raw in batch.column(at).to_pylist():
                lengths.append(len(raw) // width)
                sums.append(zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()))
            batch = batch.append_column("length", pa.array(lengths, pa.int64()))
            yield batch.append_column("ids_crc32", pa.array(sums, pa.int64())).drop_columns(["ids"])

    return run


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_vocabulary("word_bpe_49k.json")
    pieces = pack(table(spark, sf_dir, "documents"), path)
    return pieces.mapInArrow(
        _checksums(Vocabulary(path).id_bytes),
        "doc_id long, start long, doc_tokens long, sequence_id long, offset long, length long, ids_crc32 long",
    )
