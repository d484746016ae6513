"""Quality rules, importance resampling and vector codes against brute force and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import importance
from tidewatch.llm.common import join_counted, materialise, ranked
from tidewatch.llm.importance import Words, crc32_rows, feature_buckets, importance_resample
from tidewatch.llm.quality_rules import quality_rules
from tidewatch.llm.vector_codes import Codebook, compress

SCHEMA = "doc_id long, text string, lang string, source string, cell string, level string, kept string, score long"
LONG = " ".join(f"Wort{i % 977}x{i % 31}" for i in range(40_000))
TEXTS = [
    None, "", " \t\n", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h i", "x " * 500,
    "line one\nline one\n\n \n\nline one\nother", "#1 & <tag> 100% $5 |*|", LONG, LONG + "\n" + LONG,
    "é ü ñ \U0001f44d été\x0bÉTÉ\x0c\r\nend", "p q r s t u v w x y z p q r s t u v w 1 2 3 q r s t u v w x y", "x" * 3000,
    "café café-noir A1b2 \x7f\x00z",
]


def _rows(spark, rows):
    return spark.createDataFrame([(*r, "c", "l", "k", 1) for r in rows], SCHEMA)


def _features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


def test_quality_features(spark):
    docs = _rows(spark, [(i, t, None if i % 2 else "en", None if i % 3 else "s") for i, t in enumerate(TEXTS)])
    found = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    assert len(found) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r, want = found[i], _features(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules(docs.limit(0)).collect() == []


def _text(rng, length, extra=""):
    return " ".join("".join(rng.choices("abcdefghijklm", k=length)) + extra for _ in range(60))


def test_thresholds_adapt_to_cells(spark):
    rng = random.Random(3)
    rows = [(i, _text(rng, 5), "en", "short") for i in range(150)]
    rows += [(i, _text(rng, 12), "de", "long") for i in range(150, 300)]
    rows += [(300, _text(rng, 12), "en", "short"), (301, _text(rng, 12), "de", "long"),
             (302, _text(rng, 5, "$$"), "en", "short"), (303, _text(rng, 5), "en", "rare"),
             (304, _text(rng, 12), "en", "rare"), (305, _text(rng, 5).upper(), "en", "short"),
             (306, _text(rng, 12), "xx", None), (307, _text(rng, 5), "en", "short"), (307, _text(rng, 5), "en", "short")]
    found = defaultdict(list)
    for r in quality_rules(_rows(spark, rows)).collect():
        found[r["doc_id"]].append(r)
    assert all(r["kept"] for i in range(300) for r in found[i])
    assert found[300][0]["failed"] == ["word_length"] and found[301][0]["kept"]
    assert "symbols" in found[302][0]["failed"] and found[305][0]["failed"] == ["capitals"]
    assert found[303][0]["level"] == found[304][0]["level"] == "group"
    assert found[303][0]["kept"] and not found[304][0]["kept"]
    assert found[306][0]["level"] == "all"
    assert len(found[307]) == 2


def _feature_words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_crc_matrices():
    rng = np.random.default_rng(1)
    for width in (0, 1, 9, 40):
        matrix = rng.integers(0, 256, (50, width)).astype(np.uint8)
        assert crc32_rows(matrix).tolist() == [zlib.crc32(r.tobytes()) for r in matrix]


@pytest.mark.parametrize("block", [1, 2, 7, 1 << 18])
def test_feature_buckets(monkeypatch, block):
    monkeypatch.setattr(importance, "BLOCK_WORDS", block)
    texts = [t if t is None or len(t) < 5000 else t[:700] for t in TEXTS] + ["", "last one", "", None]
    for array in (pa.array(texts, pa.string()), pa.array(["cut", *texts, "cut"], pa.string())[1:-1]):
        words = Words(array)
        found = Counter()
        for text, bucket in feature_buckets(words, 10_000):
            found.update(zip(text.tolist(), bucket.tolist()))
        want = Counter((i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for f in _feature_words(t)[1])
        assert found == want
        assert np.bincount(words.text, minlength=len(texts)).tolist() == [len(_feature_words(t)[0]) for t in texts]


def _draw(docs, target, buckets=10_000, percent=25):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = Counter(bucket(f) for _, t in docs for f in _feature_words(t)[1])
    t = Counter(bucket(f) for x in target for f in _feature_words(x)[1])
    S, T = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for i, x in docs:
        words, features = _feature_words(x)
        gains = [math.floor(1000 * math.log((t[b] + 1) * S / ((s[b] + 1) * T))) for b in map(bucket, features)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(features), weight, score, len(words)])
    order = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    drawn = {r[0]: k + 1 for k, r in enumerate(order[: percent * len(order) // 100])}
    return {r[0]: (*r[1:4], drawn.get(r[0])) for r in rows}


def test_importance_resample(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(["north", "SOUTH", "east9", "größe", "x", "y"], k=rng.randint(0, 60)))) for i in range(300)]
    docs += [(1000 + i, t) for i, t in enumerate(TEXTS)]
    target = ["north north east9", None, "", "größe x"]
    frame = _rows(spark, [(i, t, "en", "s") for i, t in docs])
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance_resample(frame, wanted).collect()
    want = _draw(docs, target)
    assert len(found) == len(docs)
    assert {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in found} == want
    enough = sum(len(_feature_words(t)[0]) >= 20 for _, t in docs)
    assert sum(r["rank"] is not None for r in found) == enough // 4
    texts = importance_resample(frame, wanted, with_text=True).collect()
    assert {(r["doc_id"], r["text"]) for r in texts} == set(docs)


def test_importance_defined_cases(spark):
    same = "one two three four five " * 5
    frame = _rows(spark, [(None, same, None, None), *[(4, same, "en", "s")] * 7])
    nothing = spark.createDataFrame([], "text string")
    found = importance_resample(frame, nothing).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == [1, 2]
    assert len(found) == 8 and all(r["score"] is not None for r in found)
    assert importance_resample(frame.limit(0), nothing).collect() == []


def test_ranked_and_counted_join(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 as key", "cast(id * 37 % 101 as int) as score")
    rows = materialise(rows.repartition(5), "rows")
    found = ranked(rows, [rows.score.desc(), rows.id.asc()], "ranks").orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 1001))
    assert [(-r["score"], r["id"]) for r in found] == sorted((-r["score"], r["id"]) for r in found)
    small = materialise(rows.groupBy("key").count().filter("key > 0"), "small")
    one = sorted(map(tuple, join_counted(rows, small, "key").select("id", "count").collect()))
    two = sorted(map(tuple, join_counted(rows, small, "key", limit=2, salts=4).select("id", "count").collect()))
    assert one == two and len(one) == 1000


def test_equal_average_search():
    rng = np.random.default_rng(2)
    for k, spread in ((1, 5), (3, 4), (16, 300), (16, 2**24)):
        entries = rng.integers(-spread, spread + 1, (64, k))
        entries[10:14] = entries[3]
        parts = np.concatenate([rng.integers(-spread, spread + 1, (200, k)), entries])
        index, distance = Codebook(entries).nearest(parts)
        full = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        assert distance.tolist() == full.min(axis=1).tolist()
        assert index.tolist() == full.argmin(axis=1).tolist()
    index, distance = Codebook(np.zeros((3, 0), np.int64)).nearest(np.zeros((2, 0), np.int64))
    assert index.tolist() == distance.tolist() == [0, 0]


def _codes(rows, entries, rounds):
    x = np.array([[math.floor(1024 * v) for v in r[1]] for r in sorted(rows)], object).reshape(len(rows), 4, -1)
    books = [[list(r) for r in x[:entries, p]] for p in range(4)]

    def nearest(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(e, part)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            members = defaultdict(list)
            for part in x[:, p]:
                members[nearest(books[p], part)[1]].append(part)
            for e, m in members.items():
                books[p][e] = [sum(c) // len(m) for c in zip(*m)]
    found = [[nearest(books[p], r[p]) for p in range(4)] for r in x]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return {r[0]: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for r, f in zip(sorted(rows), found)}, digest


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, __label string, __whole int"


def test_vector_codes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, np.float32(rng.normal(size=8)).tolist()) for i in range(0, 240, 3)]
    rows += [(i + 1, v) for i, v in rows[:20]]
    bad = [(900, None), (901, [1.0] * 7 + [None]), (902, [float("nan")] + [1.0] * 7), (903, [float("-inf")] * 8),
           (904, [0.5] * 4), (905, [3e38] + [0.0] * 7), (906, [])]
    labels = [None, 0, 1]
    given = [(i, v, labels[i % 3], "c", "e", "l", 0) for i, v in rows + bad]
    frame = spark.createDataFrame(given, VECTORS).repartition(3)
    found = {r["vec_id"]: r for r in compress(frame, entries=16, rounds=4).collect()}
    want, digest = _codes(rows, 16, 4)
    assert set(found) == set(want) | {904, 905, 906}
    assert {i: (found[i]["code"], found[i]["error"]) for i in want} == want
    assert all(found[i]["code"] is None and found[i]["error"] is None for i in (904, 905, 906))
    assert {r["codebooks_sha256"] for r in found.values()} == {digest}
    total = Counter()
    for i, (_, error) in want.items():
        total[labels[i % 3]] += error
    assert all(found[i]["label_error"] == total[labels[i % 3]] for i in want)
    assert compress(frame.limit(0)).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        compress(spark.createDataFrame([(1, [1.0, 2.0], 1, "", "", "", 0)], VECTORS))


def test_vector_codes_repeated_and_null_ids(spark):
    rows = [(5, [1.0, 2.0, 3.0, 4.0])] * 3 + [(None, [9.0, 9.0, 9.0, 9.0]), (1, [0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, None, "", "", "", 0) for i, v in rows], VECTORS)
    found = compress(frame, entries=3, rounds=1).collect()
    assert len(found) == 5 and len({r["label_error"] for r in found}) == 1
    assert {r["code"] for r in found if r["vec_id"] == 1} == {"00000000"}
