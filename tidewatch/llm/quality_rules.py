"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Fixed rules reject texts that are too short or mostly repeat themselves. What passes is measured in per mille
(word length, symbols, capitals, repeated words, repeated lines, words used before), and each measure has an upper
threshold of its own in every language and source, taken from a quantile sketch of that cell:

    median + SPREAD * max(median - lower quartile, slack of the measure)

The lower half of a cell says how wide it is, so up to half of a cell may be junk without moving its own
threshold much. The sketch is a log-linear histogram: values below 256 are kept, larger ones are floored
to their eight leading bits (error below 1/128), and a cell is a count for each value that occurs.
Sketches merge by adding counts: cells of a language merge into the language, languages into one, and a cell with
fewer than LEAST documents takes the threshold of its language, or of all documents. The sketch is
exact in its counts, so neither the order of the rows nor the partitions change a threshold.

Texts are read once, features are written, thresholds are joined to the features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import join_counted, materialise, query, table, text_or_empty

WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30
SPREAD, LEAST = 6, 100
#: Least spread of each measure, in its own unit (thousandths).
SLACK = {"word_length": 300, "symbols": 20, "capitals": 20, "repeated": 60, "dup_lines": 60, "used_before": 60}

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Values below 2^KEPT_BITS are exact in the sketch.
KEPT_BITS = 8


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns that are computed once, as the output of a generator, however often they are read.

    A plain projection would be merged into the expressions that read it, and a lambda would compute it anew for each element.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def _is(a: Column, b: Column) -> Column:
    return F.coalesce((a["h"] == b["h"]) & (a["g"] == b["g"]), F.lit(False))


def with_features(docs: DataFrame, text_col: str) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_distinct.

    Windows of eight words are compared by 128 bits of their hashes, only in texts where 64 bits repeat.
    """
    has_word = F.filter(F.split(F.col("__text"), "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    split = F.filter(F.split(F.col("__text"), r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    df = _with(docs, __text=text_or_empty(text_col))
    df = _with(df, __words=split, __lines=has_word)
    n_windows = F.size("__words") - (WINDOW - 1)

    def window(i):
        return F.slice(F.col("__words"), i, WINDOW)

    hashes = F.transform(F.sequence(F.lit(1), n_windows), lambda i: F.xxhash64(window(i)))
    df = _with(df, __hashes=F.when(n_windows > 0, hashes))
    repeats = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    marked = F.transform(
        F.col("__hashes"),
        lambda h, i: F.struct(h.alias("h"), F.xxhash64(F.lit(WINDOW), window(i + 1)).alias("g"), i.alias("i")),
    )
    df = _with(df, __marked=F.when(repeats, F.sort_array(marked)))
    near = F.filter(
        F.col("__marked"),
        lambda x, k: _is(x, F.get("__marked", k - 1)) | _is(x, F.get("__marked", k + 1)),
    )
    df = _with(df, __places=F.sort_array(F.transform(near, lambda x: x["i"])))
    covered = F.transform(
        F.col("__places"), lambda p, k: F.least(F.lit(WINDOW), F.coalesce(p - F.get("__places", k - 1), F.lit(WINDOW)))
    )
    text = F.col("__text")
    features = {
        "n_words": F.size("__words"),
        "word_chars": _without(text, _SPACE),
        "n_symbols": F.char_length(text) - _without(text, _SYMBOLS),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)),
        "n_lines": F.size("__lines"),
        "n_capitals": F.char_length(text) - _without(text, _CAPITALS),
        "n_distinct": F.size(F.array_distinct("__words")),
    }
    df = _with(df, **{n: c.cast("long") for n, c in features.items()})
    return df.drop("__text", "__words", "__lines", "__hashes", "__marked", "__places")


def _per_mille(part: str, whole: str) -> Column:
    return F.expr(f"1000 * {part} div greatest({whole}, 1)")


def measures() -> dict[str, Column]:
    """The measures of a row of features, whole numbers of thousandths."""
    return {
        "word_length": _per_mille("word_chars", "n_words"),
        "symbols": _per_mille("n_symbols", "n_words"),
        "capitals": _per_mille("n_capitals", "word_chars"),
        "repeated": _per_mille("n_repeat_words", "n_words"),
        "dup_lines": _per_mille("n_dup_lines", "n_lines"),
        "used_before": _per_mille("(n_words - n_distinct)", "n_words"),
    }


def sketch(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, measure, value, n: the mergeable histogram of each of `columns` (whole numbers from 0) in each cell."""
    pairs = F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("at")) for c in columns))
    long = rows.select(*keys, F.inline(pairs))
    width = F.greatest(F.length(F.bin("at")) - KEPT_BITS, F.lit(0))
    value = F.col("at") - F.pmod(F.col("at"), F.expr("1L") * F.pow(F.lit(2), width).cast("long"))
    return long.groupBy(*keys, "measure", value.alias("value")).agg(F.count("*").alias("n"))


def merged(cells: DataFrame, key: str) -> DataFrame:
    return cells.groupBy(key, "measure", "value").agg(F.sum("n").alias("n"))


def quantiles(cells: DataFrame, key: str, percents: list[int]) -> DataFrame:
    """key, measure, n, q<percent>: least value that `percent` % of a cell's documents do not exceed.

    A window sees the values of one cell and measure, whose number the sketch bounds.
    """
    cell = Window.partitionBy(key, "measure")
    ordered = cells.select(
        key, "measure", "value",
        F.sum("n").over(cell.orderBy("value")).alias("upto"), F.sum("n").over(cell).alias("size"),
    )
    wanted = [
        F.min(F.when(100 * F.col("upto") >= p * F.col("size"), F.col("value"))).alias(f"q{p}") for p in percents
    ]
    return ordered.groupBy(key, "measure").agg(F.first("size").alias("n"), *wanted)


def thresholds(cells: DataFrame, slack: dict[str, int], spread: int, least: int) -> DataFrame:
    """cell, level, and a threshold for each measure. `cells` is a sketch by cell and its group."""
    cells = cells.withColumn("all", F.lit(""))
    per_measure = F.create_map(*(F.lit(x) for pair in slack.items() for x in pair))[F.col("measure")]
    fence = F.col("q50") + spread * F.greatest(F.col("q50") - F.col("q25"), per_measure)

    def fences(key: str) -> DataFrame:
        found = quantiles(merged(cells, key), key, [25, 50])
        return found.groupBy(key).agg(
            F.first("n").alias(f"{key}_n"),
            *(F.max(F.when(F.col("measure") == m, fence)).alias(f"{key}_{m}") for m in slack),
        )

    whole = fences("all").collect()  # one row, or none
    out = cells.select("cell", "group").distinct().join(fences("cell"), "cell").join(fences("group"), "group")

    def chosen(name: str) -> Column:
        own = F.when(F.col("cell_n") >= least, F.col(f"cell_{name}"))
        last = F.lit(whole[0][f"all_{name}"] if whole else None).cast("long")
        return own.when(F.col("group_n") >= least, F.col(f"group_{name}")).otherwise(last)

    level = F.when(F.col("cell_n") >= least, "cell").when(F.col("group_n") >= least, "group").otherwise("all")
    return out.select("cell", level.alias("level"), *(chosen(m).alias(f"max_{m}") for m in slack))


def _digest(columns: list[str]) -> Column:
    return F.md5(F.to_json(F.struct(*(F.col(c) for c in columns))))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_cols: tuple[str, str] = ("lang", "source"),
    slack: dict[str, int] | None = None,
    spread: int = SPREAD,
    least: int = LEAST,
    with_text: bool = False,
) -> DataFrame:
    """One row for each row of `docs`: doc_id, features, measures, base_failed, level, failed, kept and, if asked for, text.

    base_failed: fewer than 20 words, or more than 30 % of the words in windows of eight that occur
    twice or more. `failed` names the measures above the threshold of the document's cell, `level` says whose
    threshold it was (cell, group or all; NULL when base_failed). kept: neither. NULL text counts as empty and has 0
    of everything. NULL languages and sources are cells of their own. Values equal to a
    threshold pass. Repeated rows count and are judged one by one. An empty table gives no rows. Columns not
    named in the call are ignored, so their names cannot clash.
    """
    slack = SLACK if slack is None else slack
    group, source = group_cols
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        F.col(group).alias("__group"), F.col(source).alias("__source"),
    )
    rows = with_features(rows, "text")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = rows.select(
        "doc_id", *(["text"] if with_text else []),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        *(c.alias(n) for n, c in measures().items()), base.alias("base_failed"),
        _digest(["__group", "__source"]).alias("cell"), _digest(["__group"]).alias("group"),
    )
    rows = materialise(rows, "quality-rules")
    cells = materialise(sketch(rows.filter("not base_failed"), ["cell", "group"], list(slack)), "quality-sketch")
    fences = materialise(thresholds(cells, slack, spread, least), "quality-thresholds")
    judged = join_counted(rows, fences, "cell")
    above = F.filter(
        F.array(*(F.when(F.col(m) > F.col(f"max_{m}"), F.lit(m)) for m in slack)), lambda x: x.isNotNull()
    )
    judged = judged.withColumn("level", F.when(~F.col("base_failed"), F.col("level")))
    judged = judged.withColumn("failed", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(above))
    kept = ~F.col("base_failed") & (F.size("failed") == 0)
    return judged.withColumn("kept", kept).drop("cell", "group", *(f"max_{m}" for m in slack))


def _oracle() -> str:
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    formulas = {
        "word_length": "1000 * word_chars // greatest(n_words, 1)",
        "symbols": "1000 * n_symbols // greatest(n_words, 1)",
        "capitals": "1000 * n_capitals // greatest(word_chars, 1)",
        "repeated": "1000 * n_repeat_words // greatest(n_words, 1)",
        "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)",
        "used_before": "1000 * (n_words - n_distinct) // greatest(n_words, 1)",
    }
    long = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, base_failed, '{m}' AS measure, {e} AS share, {SLACK[m]} AS slack FROM f"
        for m, e in formulas.items()
    )
    return rf"""
    WITH d AS MATERIALIZED (
      SELECT doc_id, lang, source, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {space}) <> '') AS l
      FROM documents),
    win AS (
      SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS x
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
    twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
    rep AS (
      SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range({WINDOW})) AS j) GROUP BY doc_id),
    f AS MATERIALIZED (
      SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed
      FROM (
        SELECT d.doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
               length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
               length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
               len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
               len(list_distinct(w)) AS n_distinct, coalesce(rep.n, 0) AS n_repeat_words
        FROM d LEFT JOIN rep USING (doc_id))),
    m AS MATERIALIZED ({long}),
    h AS MATERIALIZED (
      SELECT lang, source, measure, slack, share - share % (1::BIGINT << greatest(length(bin(share)) - {KEPT_BITS}, 0)) AS value, count(*) AS n
      FROM m WHERE NOT base_failed GROUP BY ALL),
    v AS (
      SELECT 1 AS level, lang, source, * EXCLUDE (lang, source) FROM h
      UNION ALL SELECT 2, lang, NULL, measure, slack, value, sum(n) FROM h GROUP BY ALL
      UNION ALL SELECT 3, NULL, NULL, measure, slack, value, sum(n) FROM h GROUP BY ALL),
    q AS (
      SELECT level, lang, source, measure, slack, size,
             min(value) FILTER (100 * upto >= 25 * size) AS q25, min(value) FILTER (100 * upto >= 50 * size) AS q50
      FROM (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY value) AS upto,
                   sum(n) OVER (PARTITION BY level, lang, source, measure) AS size FROM v)
      GROUP BY ALL),
    fence AS (SELECT *, q50 + {SPREAD} * greatest(q50 - q25, slack) AS fence FROM q WHERE level = 3 OR size >= {LEAST}),
    verdict AS (
      SELECT m.doc_id, bool_or(share > coalesce(a.fence, b.fence, c.fence)) AS above
      FROM m
      LEFT JOIN fence a ON a.level = 1 AND a.measure = m.measure AND a.lang IS NOT DISTINCT FROM m.lang AND a.source IS NOT DISTINCT FROM m.source
      LEFT JOIN fence b ON b.level = 2 AND b.measure = m.measure AND b.lang IS NOT DISTINCT FROM m.lang
      LEFT JOIN fence c ON c.level = 3 AND c.measure = m.measure
      GROUP BY m.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT above AS kept
    FROM f JOIN verdict USING (doc_id)
    """


@query("op11_quality_rules", _oracle())
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
