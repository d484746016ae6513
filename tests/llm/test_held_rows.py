"""How many texts a task holds at once, and what its worker keeps."""

import pyarrow as pa
import pytest

from tidewatch.llm import ngram_join, packing, pii, quality, tokens


def test_texts_are_taken_in_small_batches():
    batch = pa.record_batch([pa.array(range(700)), pa.array(["a b"] * 700)], ["doc_id", "text"])
    parts = list(ngram_join._texts(iter([batch])))
    assert max(len(texts) for _, texts in parts) <= 256 and ngram_join.BATCH_ROWS <= 1000
    assert [i for part, _ in parts for i in part.column(0).to_pylist()] == list(range(700))


@pytest.mark.parametrize("name", ["packed", "quality-views", "pii-read"])
def test_jobs_on_whole_texts_take_small_arrow_batches(spark, monkeypatch, name):
    rows = [(i, f"text {i} a@b.cd +12 345 678 901", "en", "s") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").localCheckpoint()
    module = {"packed": packing, "quality-views": quality, "pii-read": pii}[name]
    at, real = {}, module.materialise

    def seen(df, table):
        at[table] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return real(df, table)

    monkeypatch.setattr(module, "materialise", seen)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    out = {
        "packed": lambda: packing.pack(docs, tokens.public_vocabulary("word_bpe_49k.json")),
        "quality-views": lambda: quality.keep_quality(docs, labels, threshold=0.0),
        "pii-read": lambda: pii.redact(docs),
    }[name]()
    assert at[name] <= 500 and {r.doc_id for r in out.collect()} == set(range(9))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 500


def test_redaction_makes_its_texts_in_small_batches():
    spans = [[{"start": 0, "kind": 0, "end": 6}] if i % 2 else None for i in range(1200)]
    batch = pa.record_batch([pa.array(["a@b.cd x"] * 1200), pa.array(spans)], ["text", "__spans"])
    parts = list(pii._redacted(["text"], "text")(iter([batch])))
    assert max(p.num_rows for p in parts) <= 500
    assert [t for p in parts for t in p.column(0).to_pylist()] == ["a@b.cd x", "[EMAIL] x"] * 600


def test_a_tokenizer_does_not_outlive_its_bucket():
    class File:
        value = open(tokens.public_vocabulary("word_bpe_49k.json"), encoding="utf-8").read()

    made, real = [], tokens._tokenizer
    words = tokens._boxed(words=pa.array(["some", "words", "some"]))
    rows = pa.table([[0], pa.array([tokens._QUESTION], pa.int32()), [0], [0], [3], [words]],
                    ["key", "kind", "block", "bucket", "mark", "box"])

    def watched(file):
        found = real(file)
        made.append(found)
        return found

    tokens._tokenizer = watched
    try:
        answers = [tokens._answers(File, "<u2")(rows).column("box")[0].as_py() for _ in range(2)]
    finally:
        tokens._tokenizer = real
    assert answers[0] == answers[1] and made[0] is not made[1]
