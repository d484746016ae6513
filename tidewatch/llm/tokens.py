"""Encoding by a table of distinct words, decoding by a table of pieces.

Words are what lies between single blanks: no pre-token crosses such a blank, so a text's ids are the
ids of its words, one after the other. Each task deals its texts to blocks and turns a block into its
distinct words and, for each text, their places. The distinct words are dealt to buckets by their hash, so
a word of any number of blocks is in one bucket, where it is encoded once. The bucket answers
each block with its words' ids in the order of the question, and the block joins them to its texts by
position. Blocks and buckets meet by the same key in one shuffle, which carries no text.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.llm.common import give_back, giving_back, query, table, text_or_empty
from tidewatch.llm.shingles import ByteSums, byte_blocks, spans

#: Bytes of text in a block, and for which there is a bucket.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
#: Distinct words that go to the tokenizer at once.
WORDS_AT_ONCE = 4096
#: Texts that are decoded at once.
ROWS_AT_ONCE = 256

#: A blank that ends a word: what stands on either side is no white space, so it is a run by itself.
_BREAK = re.compile(r"(?<=\S)(?= \S)")


def public_vocabulary(name: str) -> str:
    """Path of one of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _awkward(word: str) -> bool:
    return not word or word[0].isspace() or word[-1].isspace()


def _lower(words: pa.Array) -> pa.Array:
    """A-Z in lower case, but for words that may hold a special token's name."""
    return pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))


def distinct_words(
    column: pa.Array, keep_blanks: bool, lower: bool = False
) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of some texts, the places of all words in that list, and each text's first word.

    With keep_blanks (byte-level vocabularies) the words put together are the text: each but the
    first has the blank before it, and a blank that touches other white space or an end of the text
    ends no word. Otherwise blanks are dropped, as those vocabularies drop all white space, and line
    feeds end words, too. `lower` is for vocabularies that lower all letters.
    """
    if not keep_blanks:
        column = pc.replace_substring(column, "\n", " ")
    pieces = pc.split_pattern(column, " ")
    words = pieces.flatten()
    coded = (_lower(words) if lower else words).dictionary_encode()
    del words
    words, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    count = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    del pieces, coded
    plain = words.to_pylist()
    if not keep_blanks:
        solid = np.array([bool(w) for w in plain], bool)[at]
        text = np.repeat(np.arange(len(column)), count)[solid]
        return words, at[solid], np.searchsorted(text, np.arange(len(column) + 1))
    first = np.concatenate([[0], np.cumsum(count)])
    awkward = np.array([_awkward(w) for w in plain], bool)[at]
    through = np.concatenate([[0], np.cumsum(awkward)])
    slow = through[first[1:]] > through[first[:-1]]
    # A text's first word has no blank before it; awkward texts are split at their breaks.
    own: dict[str, int] = {}
    parts: list[np.ndarray] = []
    for i in range(len(column)):
        a, b = first[i], first[i + 1]
        if slow[i]:
            found = [w for w in _BREAK.split(column[i].as_py()) if w]
            parts.append(np.array([own.setdefault(w, len(own)) for w in found], np.int32) + len(plain))
        else:
            part = at[a:b].copy()
            part[0] = own.setdefault(plain[part[0]], len(own)) + len(plain)
            parts.append(part)
    blank = pc.binary_join_element_wise(pa.scalar(""), words, " ")
    everything = pa.concat_arrays([blank, pa.array(own.keys(), pa.string())])
    places = np.concatenate([np.empty(0, np.int32), *parts])
    used = np.zeros(len(everything), bool)
    used[places] = True
    places = (np.cumsum(used, dtype=np.int32) - 1)[places]
    return everything.filter(pa.array(used)), places, np.concatenate([[0], np.cumsum([len(x) for x in parts])])


class Vocabulary:
    """A tokenizers file: how it splits, how many bytes an id takes, and the bytes of each id."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            self.file = f.read()
        described = json.loads(self.file)
        kept = described.get("normalizer") is None and described["pre_tokenizer"]["type"] == "ByteLevel"
        self.keep_blanks = kept
        self.lower = not kept and "Lowercase" in json.dumps(described.get("normalizer"))
        ids = {**described["model"]["vocab"], **{t["content"]: t["id"] for t in described["added_tokens"]}}
        self.size = max(ids.values()) + 1
        self.id_bytes = 2 if self.size <= 1 << 16 else 4
        self.special = {t["id"] for t in described["added_tokens"]}
        self.pieces = ids

    @property
    def dtype(self) -> str:
        return f"<u{self.id_bytes}"


def _tokenizer(file: str):
    """For one bucket, since a worker would hold it for good; the file's text travels with the task, so executors need no path."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(file)
    made.no_truncation()
    made.no_padding()
    return made


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write bytes as characters: printable ones as themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in own}
    others = (b for b in range(256) if b not in set(own))
    return table | {chr(256 + i): b for i, b in enumerate(others)}


def _boxed(**columns) -> bytes:
    """Columns of one table, compressed."""
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_PRESSED) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unboxed(box: bytes) -> pa.Table:
    return pa.ipc.open_stream(box).read_all()


_PRESSED = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
_QUESTION, _TEXTS = 0, 1


def _slices(column: pa.Array):
    """Ranges of texts of about BLOCK_BYTES."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + BLOCK_BYTES)))
        yield start, min(end, len(column))
        start = end


def _asked(keep_blanks: bool, lower: bool, buckets: int):
    """For each block its texts as places in its list of distinct words, and that list by bucket."""
    names = ["key", "kind", "block", "bucket", "mark", "box"]

    def block(ids: pa.Array, texts: pa.Array, number: int):
        words, places, first = distinct_words(texts, keep_blanks, lower)
        hashes = [ByteSums(data).hashes(ends[:-1], ends[1:]) for _, data, ends in byte_blocks(words)]
        of = np.concatenate([np.empty(0, np.uint64), *hashes])
        of = (of % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words, of = words.take(pa.array(order)), of[order]
        cuts = np.concatenate([[0], np.nonzero(of[1:] != of[:-1])[0] + 1, [len(of)]]) if len(of) else [0]
        box = _boxed(
            doc=pa.array([_boxed(id=ids)], pa.binary()),
            words=pa.array([rank[places].tobytes()], pa.binary()),
            first=pa.array([first.astype(np.int64).tobytes()], pa.binary()),
        )
        rows = [(number, _TEXTS, number, 0, 0, box)]
        for a, b in zip(cuts, cuts[1:]):
            own = words.slice(a, b - a)
            rows.append((int(of[a]), _QUESTION, number, int(of[a]), b - a, _boxed(words=own)))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            column = batch.column(1).cast(pa.large_string())
            for a, b in _slices(column):
                ids.append(batch.column(0).slice(a, b - a))
                texts.append(column.slice(a, b - a))
                held += pc.sum(pc.binary_length(texts[-1])).as_py() or 0
                if held >= BLOCK_BYTES:
                    yield block(pa.concat_arrays(ids), pa.concat_arrays(texts).cast(pa.string()), number)
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield block(pa.concat_arrays(ids), pa.concat_arrays(texts).cast(pa.string()), number)

    return run


def _answers(file, dtype: str):
    """A bucket's words, each encoded once; for each block the ids of its words in its order."""
    names = ["block", "bucket", "mark", "box"]

    def run(rows):
        rows = rows.filter(pc.equal(rows.column("kind"), _QUESTION))
        tokenizer = _tokenizer(file.value)
        asked = [_unboxed(box).column("words").combine_chunks() for box in rows.column("box").to_pylist()]
        lengths = [len(words) for words in asked]
        coded = pa.concat_arrays(asked or [pa.array([], pa.string())]).dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy()
        ids = []
        for i in range(0, len(distinct), WORDS_AT_ONCE):
            part = distinct.slice(i, WORDS_AT_ONCE).to_pylist()
            part = tokenizer.encode_batch_fast(part, add_special_tokens=False)
            ids += [np.array(e.ids, dtype).tobytes() for e in part]
        del tokenizer
        ids = pa.array(ids, pa.binary())
        boxes, start = [], 0
        for n in lengths:
            found = ids.take(pa.array(at[start : start + n]))
            data, offsets = spans(found)
            counts = np.diff(offsets)
            small = np.uint8 if counts.max(initial=0) < 256 else np.uint32
            boxes.append(
                _boxed(
                    counts=pa.array([counts.astype(small).tobytes()], pa.binary()),
                    small=pa.array([small is np.uint8]),
                    ids=pa.array([data[offsets[0] : offsets[-1]].tobytes()], pa.binary()),
                )
            )
            start += n
        give_back()
        columns = [rows.column(c) for c in names[:3]]
        return pa.table([*columns, pa.chunked_array([pa.array(boxes, pa.binary())])], names)

    return run


def _joined(dtype: str, id_type: pa.DataType):
    """Ids of each text of a block: its words' ids by position."""

    def run(_, rows, answers):
        texts = rows.filter(pc.equal(rows.column("kind"), _TEXTS))
        out = [pa.table([pa.array([], id_type), pa.array([], pa.binary())], ["doc_id", "ids"])]
        for number, box in zip(texts.column("block").to_pylist(), texts.column("box").to_pylist()):
            own = answers.filter(pc.equal(answers.column("block"), number)).sort_by("bucket")
            counts, ids = [np.empty(0, np.int64)], []
            for mark, answer in zip(own.column("mark").to_pylist(), own.column("box").to_pylist()):
                table = _unboxed(answer)
                small = np.uint8 if table["small"][0].as_py() else np.uint32
                counts.append(np.frombuffer(table["counts"][0].as_py(), small).astype(np.int64))
                if len(counts[-1]) != mark:
                    raise ValueError("question and answer differ: the input's rows were not in a stable order")
                ids.append(table["ids"][0].as_py())
            width = np.dtype(dtype).itemsize
            counts = np.concatenate(counts) // width
            ids, starts = np.frombuffer(b"".join(ids), dtype), np.concatenate([[0], np.cumsum(counts)])
            table = _unboxed(box)
            words = np.frombuffer(table["words"][0].as_py(), np.uint32).astype(np.int64)
            first = np.frombuffer(table["first"][0].as_py(), np.int64)
            lengths = counts[words]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            flat = ids[np.arange(ends[-1]) + np.repeat(starts[words] - ends[:-1], lengths)].tobytes()
            cut = ends[first] * width
            docs = _unboxed(table["doc"][0].as_py()).column("id")
            found = [flat[a:b] for a, b in zip(cut, cut[1:])]
            out.append(pa.table([docs, pa.chunked_array([pa.array(found, pa.binary())])], ["doc_id", "ids"]))
        return pa.concat_tables(out)

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and `ids`: each text's token ids, little-endian unsigned, as the tokenizers library gives
    them with add_special_tokens=False, without truncation and padding.

    The input's rows must come in a stable order within their partitions, as from files. An id takes `Vocabulary(path).id_bytes` bytes. NULL counts as empty; an empty text has no ids.
    Long texts, repeated rows and NULL ids are rows like any other; an empty table gives none; other
    columns are ignored.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(path)
    text = text_or_empty(text_col)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // BUCKET_BYTES))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType
    file = spark.sparkContext.broadcast(vocabulary.file)
    asked = rows.mapInArrow(
        giving_back(_asked(vocabulary.keep_blanks, vocabulary.lower, buckets)),
        "key long, kind int, block long, bucket long, mark long, box binary",
    )
    answers = asked.groupBy("key").applyInArrow(
        _answers(file, vocabulary.dtype), "block long, bucket long, mark long, box binary"
    )
    return (
        asked.groupBy("key")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            _joined(vocabulary.dtype, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, ids binary"
        )
    )


def _small(batches):
    for batch in batches:
        yield from (batch.slice(i, ROWS_AT_ONCE) for i in range(0, batch.num_rows, ROWS_AT_ONCE))


def _decoded(vocabulary: Vocabulary):
    """Bytes of each id, one after the other, and where each id's begin."""
    byte, pieces = _byte_of_character(), [b""] * vocabulary.size
    for piece, i in vocabulary.pieces.items():
        pieces[i] = piece.encode() if i in vocabulary.special else bytes(byte[c] for c in piece)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    flat, dtype = np.frombuffer(b"".join(pieces), np.uint8), vocabulary.dtype

    def run(batches):
        for batch in _small(batches):
            texts = []
            for raw in batch.column(batch.schema.get_field_index("ids")).to_pylist():
                ids = np.frombuffer(raw or b"", dtype)
                lengths = starts[ids.astype(np.int64) + 1] - starts[ids]
                ends = np.cumsum(lengths)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[ids] - ends + lengths, lengths)
                texts.append(flat[at].tobytes().decode("utf-8", "replace"))
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    return run


def decode(encoded: DataFrame, path: str, then=None, schema: str | None = None) -> DataFrame:
    """`encoded` with `decoded`, the text of its `ids`: each id is joined to its piece.

    Byte-level vocabularies only. The table of pieces is fixed with the vocabulary and goes to the tasks
    whole; bytes that are no UTF-8 become replacement characters. NULL or empty ids give an empty text.
    `then`, a function over the resulting Arrow batches, runs in the same task and gives `schema`.
    """
    decoded = _decoded(Vocabulary(path))
    if then is not None:
        return encoded.mapInArrow(lambda batches: then(decoded(batches)), schema)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(decoded, fields + ", decoded string")


def _digests(dtype: str):
    """Digest columns of the query: ids in decimal, joined by commas."""
    from hashlib import sha256

    decimal = np.array([str(i) for i in range(1 << 16)], dtype=object)

    def run(batches):
        for batch in batches:
            counts, digests, texts = [], [], []
            for raw, text in zip(batch.column("ids").to_pylist(), batch.column("decoded").to_pylist()):
                ids = np.frombuffer(raw, dtype)
                counts.append(len(ids))
                joined = ",".join(decimal[ids]) if dtype == "<u2" else ",".join(map(str, ids.tolist()))
                digests.append(sha256(joined.encode()).hexdigest())
                texts.append(sha256(text.encode()).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests), pa.array(texts)]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_vocabulary("byte_bpe_50k.json")
    return decode(
        encode(table(spark, sf_dir, "documents"), path),
        path,
        _digests(Vocabulary(path).dtype),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
