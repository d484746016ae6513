"""Each operator against brute force, and on NULLs, empty and long texts, ties, repeated rows,
empty tables and extra columns with names that the operators use themselves."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewatch.llm import common, ngram_join, pii, tokens
from tidewatch.llm.exact_dedup import exact_dedup
from tidewatch.llm.line_dedup import drop_boilerplate
from tidewatch.llm.ngram_join import near_duplicates
from tidewatch.llm.packing import pack
from tidewatch.llm.permutation_index import nearest_neighbours
from tidewatch.llm.quality import keep_quality, quality
from tidewatch.llm.sharding import Cells, minimax_shards
from tidewatch.llm.signature_tree import bitmap, similar_pairs
from tidewatch.llm.toxicity import segments, toxicity

SMALL = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row_id string, digest string, key string, label string, best string"
)
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [
        (0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "One  two"), (5, LONG), (6, LONG + " end"),
        (7, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
        (8, "a b c d e f g h i j k l m n o p q r s t u v w x y zz"),
        (9, "mail me@site.org or 10.0.0.1, card 4111 1111 1111 1111, call +1 (555) 010-9999 now"),
        (10, "été \U0001f44d‍ <|endoftext|> x"), (11, "one two"), (11, "one two"), (None, "nobody's row"),
    ]
    rows = [(i, t, "en" if k % 2 else None, "s" if k % 3 else None, None, "r", "d", "k", "l", "b")
            for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_connected_blocks_have_no_members(spark):
    """6000 near copies of one component are no pairs to decide; a second component makes them so."""
    met = spark.range(6000).selectExpr("7L AS key", "id AS a", "CAST(NULL AS LONG) AS b", "0L AS label_a")
    other = spark.range(6000, 6001).selectExpr("7L AS key", "id AS a", "CAST(NULL AS LONG) AS b", "1L AS label_a")
    assert ngram_join._members(met).count() == 0
    assert ngram_join._members(met.union(other)).count() == 6001


def test_exact_dedup(docs, nothing):
    rows = exact_dedup(docs).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in texts:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i if i is not None else 0))
    want = {hashlib.sha256(k.encode()).hexdigest(): (len(v), min(v)[2] if not min(v)[1] else None)
            for k, v in groups.items()}
    assert len(rows) == len(texts)
    assert all((r["group_size"], r["keep_id"]) == want[r["text_sha256"]] for r in rows)
    assert sum(r["kept"] for r in rows) == len(groups)
    assert exact_dedup(nothing).count() == 0


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < 5 else zip(*(words[i:] for i in range(5))))


def _components(rows):
    sets = [(i, _shingles(t)) for i, t in rows]
    least = list(range(len(sets)))

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                least[root(a)] = root(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        ids[root(k)].append(i)
    return Counter(
        (i, len(s), min((j for j in ids[root(k)] if j is not None), default=None) if s else i)
        for k, (i, s) in enumerate(sets)
    )


def test_near_duplicates(spark, docs, nothing):
    got = Counter(tuple(r) for r in near_duplicates(docs).collect())
    assert got == _components([(r["doc_id"], r["text"]) for r in docs.collect()])
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(150):  # a cloud of near copies around the limit, and unrelated texts
        words = list(base) if i % 3 else [f"u{x}" for x in rng.integers(0, 40, 30)]
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, len(words)))] = f"e{rng.integers(0, 9)}"
        rows.append((i, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == _components(rows)
    assert near_duplicates(nothing).count() == 0


def test_signature_trees_lose_no_pair():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(300):
        n = int(rng.integers(1, 120))
        sets.append(rng.integers(0, 2**63, n).astype(np.uint64))
        sets.append(np.concatenate([sets[-1][: max(1, int(n * 0.95))], rng.integers(0, 2**63, 2).astype(np.uint64)]))
    sets = [np.unique(s) for s in sets]
    sizes = np.array([len(s) for s in sets])
    found = set()
    for a, b, _ in similar_pairs(sizes, [bitmap(s) for s in sets], np.arange(len(sets)), 80):
        found |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 80 * (sizes[a] + sizes[b] - common):
                assert (a, b) in found


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encode_and_decode(docs, nothing, name):
    from tokenizers import Tokenizer

    path = tokens.public_vocabulary(name)
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    encoded = tokens.encode(docs, path)
    want = Counter()
    for r in docs.collect():
        want[(r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids))] += 1
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u2").tolist())) for r in encoded.collect()) == want
    if name.startswith("byte"):
        back = Counter((r["doc_id"], r["decoded"]) for r in tokens.decode(encoded, path).collect())
        assert back == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert tokens.encode(nothing, path).count() == 0


def test_packing(docs, nothing):
    path = tokens.public_vocabulary("word_bpe_49k.json")
    ids = defaultdict(list)
    for r in tokens.encode(docs, path).collect():
        ids[r["doc_id"]].append(r["ids"] + b"\x01\x00")
    pieces, sequences, covered = pack(docs, path, n_open=2).collect(), defaultdict(list), Counter()
    for p in pieces:
        assert any(raw[2 * p["start"] : 2 * p["start"] + len(p["ids"])] == p["ids"] for raw in ids[p["doc_id"]])
        sequences[p["sequence_id"]].append((p["offset"], len(p["ids"]) // 2))
        covered[p["doc_id"]] += len(p["ids"])
    assert covered == {i: sum(map(len, raw)) for i, raw in ids.items()}
    for rows in sequences.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= 2048
    assert pack(nothing, path).count() == 0


def test_shards(docs, nothing):
    rows = minimax_shards(docs, shards=3).collect()
    texts = Counter((r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 8)
                    for r in docs.collect())
    assert Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in rows) == texts
    slots, places = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        places[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= {0, 1, 2}
    assert all(len(p) == 1 for p in places.values())
    assert minimax_shards(nothing).count() == 0


def test_least_capacity_is_least():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = rng.integers(1, 50, int(rng.integers(1, 12))).tolist()
        shards = int(rng.integers(1, 5))
        cells = Cells([(1, 0, f"{i:04}", s, True) for i, s in enumerate(sizes)])

        def best(at, left):
            if at == len(sizes):
                return 0
            if not left:
                return float("inf")
            return min(max(sum(sizes[at:end]), best(end, left - 1)) for end in range(at + 1, len(sizes) + 1))

        assert cells.least_capacity(shards, False) == best(0, shards)


def test_cells_are_refined_until_exact(spark, monkeypatch):
    from tidewatch.llm import sharding

    rng = np.random.default_rng(2)
    rows = [(i, "x" * int(rng.integers(0, 400))+ str(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = Counter(r["shard"] for r in minimax_shards(df, shards=5, coarse=1).collect())
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    assert Counter(r["shard"] for r in minimax_shards(df, shards=5, coarse=1).collect()) == whole


def test_line_dedup(spark, docs, nothing):
    rows = [(i, f"own {i}\n Home | Shop\t\n\nown {i}" if i % 2 else f"own {i}\nonce", "h") for i in range(20)]
    rows += [(20, " Home | Shop", "other"), (21, None, "h"), (22, "Home | Shop", "h"), (23, "x\ny", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in drop_boilerplate(df, ratio=0.4).collect()}
    assert got[1]["text"] == "own 1\n\nown 1" and got[1]["n_dropped"] == 1 and got[1]["n_lines"] == 4
    assert got[2]["text"] == "own 2\nonce" or got[2]["n_dropped"] == 1  # `once` is on 10 of 22 documents
    assert got[20]["text"] == " Home | Shop" and got[21]["text"] is None and got[22]["text"] == ""
    assert got[23]["text"] == "x\ny"
    assert by_row(drop_boilerplate(docs)) == by_row(docs)
    assert drop_boilerplate(nothing).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = [rng.normal(size=8).astype(float).tolist() for _ in range(400)]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(i, vectors[7], "x") for i in range(400, 500)]
    rows += [(900, None, "x"), (901, [0.0] * 8, "x"), (902, [float("nan")] * 8, "x"), (903, [1.0, None] * 4, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    found = defaultdict(list)
    for r in nearest_neighbours(df, df.filter("vec_id % 50 = 0")).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x, ids, hits = np.array([r[1] for r in rows[:500]]), np.arange(500), 0
    assert set(found) == set(range(0, 500, 50))
    for q, rows_ in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((ids, d)) if i != q][:10]
        hits += len(set(best) & {i for _, i, _ in rows_})
        assert [r for r, _, _ in sorted(rows_)] == list(range(1, 11))
        assert all(abs(d[i] - s) < 1e-12 for _, i, s in rows_)
    assert hits >= 0.9 * 10 * len(found)
    few = df.filter("vec_id in (1, 2, 3)")
    assert nearest_neighbours(few, few).count() == 6
    assert nearest_neighbours(df.limit(0), df.limit(0)).count() == 0


def test_segments_are_maximal():
    rng = np.random.default_rng(6)
    for _ in range(200):
        scores = rng.integers(-3, 4, int(rng.integers(1, 15))).astype(float)
        total = np.concatenate([[0.0], np.cumsum(scores)])
        best = max((total[b] - total[a] for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
        found = segments(scores)
        assert (max(s for s, _, _ in found) == best) if best > 0 else not found
        assert all(s == total[b] - total[a] and s > 0 for s, a, b in found)
        assert all(x[2] <= y[1] for x, y in zip(found, found[1:]))
        for _, a, b in found:  # every proper part of a maximal segment scores less than the whole
            assert all(total[a] < total[k] <= total[b] or k == b for k in range(a + 1, b + 1))


def test_toxicity(spark, docs, nothing):
    rows = [(i, " ".join(f"plain{(i * 7 + k) % 50}" for k in range(40)) + (" vile slur" * 3 if i % 4 == 0 else ""))
            for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (5, None)],
                                   "doc_id long, toxic int")
    scored = toxicity(df, labels).collect()
    assert len(scored) == 400 and all((r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in scored)
    for r in scored:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if r["predicted"]:
            text = rows[r["doc_id"]][1]
            assert "slur" in "".join(text[p["start"] : p["end"]] for p in r["passages"])
    got = toxicity(docs, labels)
    assert got.count() == docs.count() and got.filter("score is null").isEmpty()
    assert toxicity(nothing, labels).count() == 0
    assert {r["score"] for r in toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_base_spans(docs):
    text = "x a.b@c.de 1.2.3.4 1.2.3.400 4111-1111 1111 1111 4111111111111112 +49 (30) 1234567-8 +1 2"
    kinds = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.base_spans(text)]
    assert kinds == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("phone", "+49 (30) 1234567-8")]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    found = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert [pii.KINDS[s["kind"]] for s in found[9]["base"]] == ["email", "ip", "card", "phone"]
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert masked[9] == "mail [EMAIL] or [IP], card [CARD], call [PHONE] now" and masked[0] is None


def test_base_spans_of_all_documents(spark):
    """Against the contract's patterns, each applied to the whole text on its own."""
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m, d: 12 <= len(d) <= 19 and sum(
            sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15),
    ]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = Counter()
    for r in docs.collect():
        spans = [(m.start(), k, m.end()) for k, (pattern, good) in enumerate(rules)
                 for m in re.finditer(pattern, r["text"] or "") if good(m[0], re.sub(r"[^0-9]", "", m[0]))]
        want[(r["doc_id"], tuple(sorted(spans)))] += 1
    found = pii.find_pii(docs).collect()
    assert Counter((r["doc_id"], tuple((s["start"], s["kind"], s["end"]) for s in r["base"])) for r in found) == want
    assert sum(len(spans) for _, spans in want) > 50


def test_keys_discover_secrets_and_shapes_discover_numbers(spark):
    digest = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(200)]
    rows = [(i, f"note {i} api_key = '{digest[i]}' end {i % 9}") for i in range(30)]
    rows += [(100 + i, f"see api_key = 'pass{i}word' now") for i in range(3)]  # not random-looking
    rows += [(200 + i, f"fixed in commit = '{digest[100 + i]}' by {i}") for i in range(30)]  # public
    rows += [(300 + i, f"file {digest[140 + i]} of {i}") for i in range(30)]  # no key
    rows += [(400 + i, f"mode = 'level{i}of9' {i}") for i in range(30)]  # a key without secrets
    card = ["4111111111111111", "4012888888881881", "4222222222222220", "4000056655665556", "4242424242424242",
            "4000000000000002", "4000000000000069", "4000000000000119", "4000000000000127", "4000000000000101"]
    good = [c for c in card if pii.luhn(c)]
    assert len(good) >= 8
    rows += [(500 + i, f"w{i}x paid {c}, y{i}z") for i, c in enumerate(good)]
    rows += [(600, f"a {good[0]} {good[1]} b"), (601, f"a {good[0]} 4111111111111112 b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    added = {r["doc_id"]: [(pii.LABELS[s["kind"]], text[r["doc_id"]][s["start"] : s["end"]]) for s in r["added"]]
             for r in pii.find_pii(df).collect()}
    want = {i: [("secret", digest[i])] for i in range(30)} | {100 + i: [("secret", f"pass{i}word")] for i in range(3)}
    want |= {600: [("card", good[0]), ("card", good[1])], 601: [("card", good[0])]}
    assert {i: spans for i, spans in added.items() if spans} == want
    clash = df.selectExpr("doc_id", "text", "text AS __spans", "doc_id AS __id", "1 AS __hash", "'c' AS c0")
    clean = {r["doc_id"]: r for r in pii.redact(clash).collect()}
    assert len(clean) == len(rows) and clean[600]["text"] == "a [CARD] [CARD] b" and clean[600]["__spans"] == text[600]
    assert clean[3]["text"] == "note 3 api_key = '[SECRET]' end 3" and clean[200]["text"] == text[200]


def test_redact_empty_repeated_and_missing(spark, nothing):
    rows = [(1, "me@site.org"), (1, "me@site.org"), (1, "you"), (None, "a@b.cd"), (2, None), (3, "")]
    clean = pii.redact(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(1, "[EMAIL]"), (1, "[EMAIL]"), (1, "you"), (None, "[EMAIL]"), (2, None), (3, "")]
    assert by_row(clean) == Counter(want)
    empty = pii.redact(nothing)
    assert empty.count() == 0 and empty.columns == nothing.columns


def test_contexts_discover_unseen_identifiers(spark, nothing):
    rows = [(i, f"note {i % 7} please call me +1 555 010 {1000 + i} today") for i in range(60)]
    rows += [(100 + i, f"please call me 555-01{i:02}-77 today") for i in range(10)]
    rows += [(200 + i, f"the year 19{i:02} was long, item 555-01{i:02}-88 sold") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    added = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["added"]] for r in pii.find_pii(df).collect()}
    assert all(added[100 + i] == [(3, 15, 26)] for i in range(10))
    assert all(not spans for i, spans in added.items() if not 100 <= i < 110)
    assert pii.find_pii(nothing).count() == 0


def test_quality(spark, docs, nothing):
    good = "The quiet river runs past an old mill, and people walk there in the evening."
    rows = [(i, f"{good} {i}" if i % 3 else f"BUY!! NOW!! {i} " * 12, "en", f"s{i % 5}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(3, None)], "doc_id long, quality int")
    judged = quality(df, labels).collect()
    assert len(judged) == 600 and all(r["keep"] == (r["doc_id"] % 3 > 0) for r in judged)
    assert keep_quality(df, labels).count() == 400
    assert by_row(keep_quality(docs, labels.limit(0))) == by_row(docs)
    assert quality(docs, labels).count() == docs.count()
    assert quality(nothing, labels).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = common.table(spark, SMALL, "documents")
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == pipeline.COLUMNS
        after = common.materialise(after, name)
        assert 0 < after.count() <= docs.count()
        docs = after
    pieces = pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_queries_have_the_columns_of_their_contracts(spark):
    import __spark_entry__ as entry

    wanted = {
        "op1_": {"doc_id", "n_shingles", "component_id"},
        "op9_": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op4_": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
        "op8_": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    }
    queries = entry.queries()
    assert len([q for q in queries if re.match(r"op\d+_", q)]) == 13 and "pipeline" in queries
    for start, columns in wanted.items():
        name = next(q for q in queries if q.startswith(start))
        assert columns <= set(queries[name](spark, SMALL).columns)
