"""Personal data: fixed patterns, and bootstrapped contexts that find more.

The base patterns find emails, IPv4 addresses, cards and phone numbers; these are the seeds of their kinds. A fifth kind,
secret (keys, tokens, passwords), has strings that look random as seeds. Seeds induce patterns of four sorts: the
two words before a string, the words on both sides, the key it is assigned to with sign and quote (`token = "_`), and the
shape of a number with its check digit. The strings that stand in a pattern are its instances. Over a few rounds Spark scores
the graph of patterns and instances: a pattern is as good for a kind as the share of its distinct instances that are
of that kind, an instance as good as its patterns together make it. Strings that may be of a
kind, were not found by its base pattern, and stand in good patterns are added. A random-looking string alone is no
secret: only keys that are assigned such values make it one, and keys of public digests (PUBLIC_KEYS) never do.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.llm.common import (
    TEXT_ROWS,
    arrow_batches,
    giving_back,
    join_counted,
    materialise,
    query,
    table,
    text_or_empty,
)

# Kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Parts of key names whose values are meant to be seen.
PUBLIC_KEYS = {
    "build", "checksum", "commit", "digest", "etag", "hash", "id", "integrity", "md5", "rev", "revision", "sha",
    "sha1", "sha256", "sha512", "uuid", "version",
}

#: The base kinds and the one that only the patterns find.
SECRET = len(KINDS)
LABELS = (*KINDS, "secret")

#: Rounds of scoring; distinct known instances and confidence that make a pattern good; score that accepts.
ROUNDS, LEAST_SEEDS, CONFIDENCE, ACCEPT = 3, 8, 0.8, 0.8
#: Characters before and after a span in which its context words are looked for.
CONTEXT = 80
#: Documents with spans up to which the spans are broadcast to the texts.
BROADCAST_ROWS = 100_000

_DIGIT_OR_AT = re.compile(r"[0-9@]+")
_WORD = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[0-9 ().+/-]+")
_ADDRESS = re.compile(r"[0-9A-Fa-f]{0,4}(?:[:.][0-9A-Fa-f]{0,4}){3,7}")
_EDGES = ".,;:!?\"'`<>[]{}#*$&|~"
_QUOTES = "\"'`"
_TOKEN = re.compile(r"[A-Za-z0-9+/=_.~-]{8,}")
_CHANGE = re.compile(r"[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]")
_KEY = re.compile(r"([A-Za-z][A-Za-z0-9_.-]*)[\"']?[ \t]*(=>|:=|=|:)[ \t]*([\"'`]?)$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches that pass their checks."""
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    if _DIGITS.search(text) is None:
        return found
    for m in IP.finditer(text):
        if all(int(part) <= 255 if len(part) < 10 else int(part.lstrip("0")[:4] or 0) <= 255 for part in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _looks_like(value: str) -> int:
    """Bit mask of the kinds that the string may be."""
    digits, mask = len(_DIGITS.findall(value)), 0
    mask |= 1 * bool(re.search(r"\w\s?(?:@|\(at\)|\[at\])\s?\w", value))
    mask |= 2 * bool(digits >= 3 and _ADDRESS.fullmatch(value))
    if _NUMBER.fullmatch(value):
        mask |= 4 * (12 <= digits <= 19) | 8 * (7 <= digits <= 15)
    elif _TOKEN.fullmatch(value) and digits and not value.replace(".", "").isdigit():
        mask |= 1 << SECRET
    return mask


def _random_looking(value: str) -> bool:
    """At least 20 letters and digits that take turns, as in hexadecimal and base64 keys."""
    if len(value) < 20 or not _TOKEN.fullmatch(value):
        return False
    changes = sum(_CHANGE.match(value, i) is not None for i in range(len(value) - 1))
    return 5 * changes >= len(value)


def _strings(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Strings with digits or @ that no base span touches, cut at white space, quotes and before at =.

    Numbers side by side are one string, and each that is long enough for a card is one as well.
    """
    out: list[tuple[int, int]] = []
    alone: list[tuple[int, int]] = []
    reached = 0
    for m in _DIGIT_OR_AT.finditer(text):
        if m.start() < reached:
            continue
        start, end = m.start(), m.end()
        while start > reached and not text[start - 1].isspace() and text[start - 1] not in "\"'`=":
            start -= 1
        while end < len(text) and not text[end].isspace() and text[end] not in _QUOTES:
            end += 1
        reached = end
        while start < end and text[start] in _EDGES:
            start += 1
        while end > start and text[end - 1] in _EDGES:
            end -= 1
        if start >= end or any(a < end and start < b for a, _, b in taken):
            continue
        if out and out[-1][1] + 1 == start and text[start - 1] == " ":
            joined = text[out[-1][0] : end]
            if len(joined) <= 30 and _NUMBER.fullmatch(joined):
                if end - start >= 12:
                    alone.append((start, end))
                if out[-1][1] - out[-1][0] >= 12:
                    alone.append(out[-1])
                out[-1] = (out[-1][0], end)
                continue
        out.append((start, end))
    return sorted({*out, *alone})


def _contexts(text: str, start: int, end: int) -> list[str]:
    """Patterns in which text[start:end] stands; assignments begin with =, shapes with #."""
    value, found = text[start:end], []
    if (key := _KEY.search(text[max(0, start - CONTEXT) : start])) is not None:
        name = key.group(1).lower()
        if PUBLIC_KEYS.isdisjoint(re.split(r"[_.-]", name)):
            found.append(f"={name} {key.group(2)} {key.group(3)}_")
    if _NUMBER.fullmatch(value) and 12 <= len(digits := "".join(_DIGITS.findall(value))) <= 19:
        found.append(f"#{_DIGITS.sub('9', value)} {'good' if luhn(digits) else 'bad'}")
    left = _WORD.findall(text[max(0, start - CONTEXT) : start].lower())
    right = _WORD.findall(text[end : end + CONTEXT].lower())
    if len(left) >= 2:
        found.append(f"{left[-2]} {left[-1]} _")
    if left and right:
        found.append(f"{left[-1]} _ {right[0]}")
    return found


_SPAN = "struct<start: int, kind: int, end: int>"
_STRING = "struct<start: int, end: int, value: string, kind: int, fits: int, contexts: array<string>>"


def _read(id_type: pa.DataType):
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    string = pa.struct(
        [
            ("start", pa.int32()),
            ("end", pa.int32()),
            ("value", pa.string()),
            ("kind", pa.int32()),
            ("fits", pa.int32()),
            ("contexts", pa.list_(pa.string())),
        ]
    )

    def run(batches):
        for batch in batches:
            base, strings = [], []
            for text in batch.column(2).to_pylist():
                spans = base_spans(text)
                base.append([dict(zip(("start", "kind", "end"), s)) for s in spans])
                rows = [(a, b, k, 1 << k) for a, k, b in spans]
                if "@" in text or _DIGITS.search(text):
                    for a, b in _strings(text, spans):
                        seed = SECRET if _random_looking(text[a:b]) else -1
                        rows.append((a, b, seed, _looks_like(text[a:b])))
                strings.append(
                    [
                        {
                            "start": a,
                            "end": b,
                            "value": text[a:b].lower(),
                            "kind": kind,
                            "fits": fits,
                            "contexts": _contexts(text, a, b),
                        }
                        for a, b, kind, fits in rows
                    ]
                )
            columns = [
                batch.column(0), batch.column(1), pa.array(base, pa.list_(span)), pa.array(strings, pa.list_(string))
            ]
            yield pa.record_batch(columns, ["doc_id", "text_hash", "base", "strings"])

    return run


def _score_columns(make):
    return [make(k).alias(f"s{k}") for k in range(len(LABELS))]


#: Strings that no base pattern found.
UNKNOWN = f"kind IN (-1, {SECRET})"


def good_patterns(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges: context, value, kind (-1: no seed), fits, missed (a base pattern missed it somewhere). Returns (context, c0…c4), (value, s0…s4).

    c_k is the pattern's confidence for kind k, 0 where it is not good; s_k the score of a string
    that no base pattern found. Only assignments are patterns of secrets.
    """
    known = _score_columns(lambda k: F.when(F.col("kind") == k, 1.0).otherwise(0.0))
    scored = edges.select("context", "value", "kind", "fits", *known)
    for round_ in range(ROUNDS):
        totals = [F.sum(f"s{k}").alias(f"t{k}") for k in range(len(LABELS))]
        seeds = [
            F.sum(F.when(F.col(f"s{k}") >= ACCEPT, 1).otherwise(0)).alias(f"n{k}") for k in range(len(LABELS))
        ]
        patterns = scored.groupBy("context").agg(F.count("*").alias("n"), *totals, *seeds)

        def confidence(k):
            share = F.col(f"t{k}") / (F.col("n") + 1)
            good = (F.col(f"n{k}") >= LEAST_SEEDS) & (share >= CONFIDENCE)
            return F.when(good & F.col("context").startswith("=") if k == SECRET else good, share).otherwise(0.0)

        patterns = patterns.select("context", *(confidence(k).alias(f"c{k}") for k in range(len(LABELS))))
        patterns = materialise(patterns.filter("c0 + c1 + c2 + c3 + c4 > 0"), "pii-patterns")
        unknown = edges.filter("missed AND fits > 0")
        unknown = join_counted(unknown, patterns, "context").filter("c0 is not null")

        def noisy_or(k):
            fits = F.col("fits").bitwiseAND(F.lit(1 << k)) > 0
            return 1 - F.exp(F.sum(F.when(fits, F.log(1 - F.least(F.col(f"c{k}"), F.lit(0.999)))).otherwise(0.0)))

        values = materialise(unknown.groupBy("value").agg(*_score_columns(noisy_or)), "pii-values")
        if round_ + 1 < ROUNDS:
            if values.isEmpty():
                break
            found = values.select("value", *(F.col(f"s{k}").alias(f"f{k}") for k in range(len(LABELS))))
            scored = (
                edges.join(found, "value", "left")
                .select(
                    "context",
                    "value",
                    "kind",
                    "fits",
                    *_score_columns(
                        lambda k: F.when(F.col("kind") == k, 1.0)
                        .when(F.col("kind") == -1, F.coalesce(f"f{k}", F.lit(0.0)))
                        .otherwise(0.0)
                    ),
                )
            )
    return patterns, values


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text_hash, base, added (arrays of start, kind, end; in code points).

    kind counts LABELS; base are the matches of the fixed patterns, added the strings that good
    patterns give. NULL counts as empty, which has no spans. Whole texts are read, however long. Spans of
    different kinds may overlap. Repeated rows are rows of their own, and so are NULL ids. An empty table
    gives no rows; other columns are ignored, whatever their names. Ties between kinds go to the first of LABELS. text_hash is xxhash64 of the text.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType
    read = rows.mapInArrow(
        giving_back(_read(to_arrow_type(kind))),
        f"doc_id {kind.simpleString()}, text_hash long, base array<{_SPAN}>, strings array<{_STRING}>",
    )
    with arrow_batches(docs.sparkSession, TEXT_ROWS):
        read = materialise(read.withColumn("row_id", F.monotonically_increasing_id()), "pii-read")
    strings = read.select("row_id", F.explode("strings").alias("string")).select("row_id", "string.*")
    placed = strings.select(
        "row_id", "start", "end", "value", "kind", "fits", F.explode("contexts").alias("context")
    )
    edges = placed.groupBy("context", "value").agg(
        F.max("kind").alias("kind"), F.bit_or("fits").alias("fits"), F.max(F.expr(UNKNOWN)).alias("missed")
    )
    patterns, values = good_patterns(materialise(edges, "pii-edges"))

    def sure(k):
        return F.when(F.col(f"s{k}") >= ACCEPT, F.col(f"s{k}") * F.signum(f"c{k}")).otherwise(0.0)

    best = F.greatest(*(sure(k) for k in range(len(LABELS))))
    which = F.coalesce(*(F.when(sure(k) == best, k) for k in range(len(LABELS))))
    unknown = join_counted(placed.filter(UNKNOWN).drop("kind"), patterns, "context").filter("c0 is not null")
    unknown = unknown.join(values, "value").filter(best > 0).select("row_id", F.struct("start", which.alias("kind"), "end").alias("span"))
    added = unknown.groupBy("row_id").agg(F.sort_array(F.collect_set("span")).alias("added"))
    none = F.array().cast(f"array<{_SPAN}>")
    return read.join(added, "row_id", "left").select(
        "doc_id", "text_hash", "base", F.coalesce("added", none).alias("added")
    )


def _redacted(names: list[str], text_col: str):
    def run(batches):
        for batch in (b.slice(i, TEXT_ROWS) for b in batches for i in range(0, b.num_rows, TEXT_ROWS)):
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(batch.schema.get_field_index("__spans")).to_pylist()):
                if not spans:
                    continue
                parts, reached = [], 0
                for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if span["start"] >= reached:
                        parts += [texts[i][reached : span["start"]], f"[{LABELS[span['kind']].upper()}]"]
                    reached = max(reached, span["end"])
                texts[i] = "".join([*parts, texts[i][reached:]])
            batch = batch.set_column(at, text_col, pa.array(texts, pa.string()))
            yield batch.select(names)

    return run


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; spans that overlap by that of the first.

    All rows and columns stay, in any order; NULL and empty texts stay as they are, whole texts are read. Repeated rows are
    redacted alike, rows that share an id by their own text; a NULL id is an id. An empty table gives an empty one. Of columns named
    __id, __hash or __spans the values stay too.
    """
    columns = docs.columns
    docs = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    id_col, text_col = (f"c{columns.index(c)}" for c in (id_col, text_col))
    return _marked(docs, id_col, text_col).toDF(*columns)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spans = find_pii(docs, id_col, text_col).withColumn("__spans", F.concat("base", "added"))
    spans = spans.filter(F.size("__spans") > 0).groupBy("doc_id", "text_hash").agg(F.first("__spans").alias("__spans"))
    spans = materialise(spans, "pii-spans").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__spans"
    )
    few = spans.count() <= BROADCAST_ROWS
    marked = docs.join(
        F.broadcast(spans) if few else spans,
        docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(text_or_empty(text_col)) == F.col("__hash")),
        "left",
    ).drop("__id", "__hash")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return marked.mapInArrow(giving_back(_redacted(docs.columns, text_col)), schema)


def _written(spans):
    names = F.array(*(F.lit(k) for k in LABELS))
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
        ),
        ",",
    )


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def count(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select(
        "doc_id",
        *(count(k) for k in range(len(KINDS))),
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.size(F.filter("added", lambda s: s["kind"] == SECRET)).cast("long").alias("n_secret"),
    )
