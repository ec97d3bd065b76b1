"""Quality rules with thresholds that follow the data.

Instead of fixed cutoffs every language and source gets its own: the metrics of its documents go
into quantile sketches, and a document is an outlier when a metric lies beyond a fence drawn from
the quantiles of its group: beyond its quartiles by ``REACH`` times their distance (word length,
symbols), or above all but the last ``TAIL`` of the group (repeated lines and words, which most
documents don't have at all, so that quartiles say nothing).

The sketch is a histogram with buckets of 1/32 relative width (values below 64 are exact).  Two
sketches merge by adding counts, so it is an ordinary sum by (lang, source, metric, bucket):
partial sums are made before the shuffle, a hot source costs its buckets and not its rows, and the
result doesn't depend on the order of merging.  A group has at most 64 + 32 x 58 buckets, however
many documents it holds.

Everything is a DataFrame function.  Each row is judged by its own metrics, so repeated rows are
kept apart without a join on ids.  Null texts count as empty; null languages and sources are groups
of their own; an empty table gives an empty result; columns other than doc_id, text, lang and source
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import SPACE_CHARS, stored, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
SYMBOLS = "#*$%&|<>"

#: metric -> (has lower fence, slack added to the interquartile range); metrics with quartile fences.
#: The slack of word length is two sketch buckets at common lengths; that of symbols, one in a hundred
#: characters, keeps groups that mostly have none from rejecting a single sign.
SPREAD = {"word_millichars": (True, 256), "symbol_ppm": (False, 10_000)}
#: Fences lie this many (interquartile range + slack) outside the quartiles.
REACH = 3
#: metrics whose fence is a high quantile, and the part of a group above it (one in so many).
HIGH = ("dup_line_ppm", "repeat_ppm")
TAIL = 200
METRICS = (*SPREAD, *HIGH)


def repeated_words(found: str) -> Column:
    """Words covered by 8-word windows that occur twice or more in the array column ``found``.

    Window hashes are sorted as plain longs; only texts that hold an equal pair sort (hash,
    position) pairs, mark both sides of equal neighbours and add up what the marked windows cover.
    """
    hashes = (
        f"transform(sequence(1, size({found}) - {WINDOW - 1}),"
        f" i -> xxhash64(slice({found}, i, {WINDOW})))"
    )
    covered = f"""
      transform(array(sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
        aggregate(
          sort_array(transform(
            filter(s, (e, i) -> (i > 0 AND e.x = s[i - 1].x)
                                OR (i + 1 < size(s) AND e.x = s[i + 1].x)),
            e -> e.i)),
          named_struct('n', 0L, 'last', -{WINDOW}),
          (a, p) -> named_struct('n', a.n + least({WINDOW}, p - a.last), 'last', p),
          a -> a.n))[0]"""
    some = "exists(transform(array(sort_array(h)), s -> exists(sequence(1, size(s) - 1), i -> s[i] = s[i - 1])), x -> x)"
    return F.expr(
        f"""CASE WHEN size({found}) <= {WINDOW} THEN 0L
        ELSE transform(array({hashes}), h -> CASE WHEN {some} THEN {covered} ELSE 0L END)[0] END"""
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        "doc_id",
        "lang",
        "source",
        words(F.col("text")).alias("_words"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
    )
    return counted.select(
        "doc_id",
        "lang",
        "source",
        F.size("_words").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words("_words").alias("n_repeat_words"),
    )


def _metrics(counts: DataFrame) -> DataFrame:
    per = lambda top, unit, below: F.expr(f"({unit}L * {top}) div greatest({below}, 1L)")
    return counts.withColumns(
        {
            "base_failed": F.expr(
                f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words"
            ),
            "word_millichars": per("word_chars", 1000, "n_words"),
            "symbol_ppm": per("n_symbols", 1_000_000, "word_chars"),
            "dup_line_ppm": per("n_dup_lines", 1_000_000, "n_lines"),
            "repeat_ppm": per("n_repeat_words", 1_000_000, "n_words"),
        }
    )


def bucket(value: str) -> str:
    """Lower bound of a value's sketch bucket: its six leading bits."""
    shift = f"greatest(length(bin({value})) - 6, 0)"
    return f"shiftleft(shiftright({value}, {shift}), {shift})"


def sketch(metrics: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) of the rows that pass the base rules."""
    pairs = ", ".join(f"'{m}', {m}" for m in METRICS)
    return (
        metrics.where(~F.col("base_failed"))
        .select("lang", "source", F.expr(f"stack({len(METRICS)}, {pairs}) AS (metric, value)"))
        .groupBy("lang", "source", "metric", F.expr(bucket("value")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fences(sketches: DataFrame) -> DataFrame:
    """One row per language and source with the lower and upper fence of each metric."""
    group = Window.partitionBy("lang", "source", "metric")
    ranked = sketches.select(
        "*",
        F.sum("n").over(group).alias("_all"),
        F.sum("n").over(group.orderBy("bucket")).alias("_upto"),
    )
    at = lambda part, of: F.min(F.expr(f"CASE WHEN {of} * _upto >= {part} * _all THEN bucket END"))
    quantiles = ranked.groupBy("lang", "source", "metric").agg(
        at(1, 4).alias("q1"), at(3, 4).alias("q3"), at(TAIL - 1, TAIL).alias("high")
    )
    out = []
    for metric in METRICS:
        mine = F.col("metric") == metric
        for side, fence in fence_of(metric).items():
            out.append(F.max(F.when(mine, F.expr(fence))).alias(f"{metric}_{side}"))
    return quantiles.groupBy("lang", "source").agg(*out)


def fence_of(metric: str) -> dict[str, str]:
    """SQL of a metric's fences over the quantiles q1, q3 and high (lower bounds of buckets)."""
    if metric in HIGH:  # the last value of the bucket
        return {"high": "high + shiftleft(1L, greatest(length(bin(high)) - 6, 0)) - 1"}
    lower, slack = SPREAD[metric]
    fences = {"low": f"q1 - {REACH} * (q3 - q1 + {slack})"} if lower else {}
    return fences | {"high": f"q3 + {REACH} * (q3 - q1 + {slack})"}


def judge(docs: DataFrame) -> DataFrame:
    """Counts, metrics, fences and the verdict ``kept`` of every row.

    Texts are read once: the counts are stored, then sketched, then joined with the fences.  The
    fence table has one row per language and source; the join is left to the optimizer, which may
    split a hot source.
    """
    rows = stored(_metrics(measure(docs)), "quality")
    limits = fences(sketch(rows)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = rows.join(
        limits,
        rows["lang"].eqNullSafe(limits["_lang"]) & rows["source"].eqNullSafe(limits["_source"]),
        "left",
    ).drop("_lang", "_source")
    outside = F.lit(False)
    for metric in METRICS:
        for side in fence_of(metric):
            limit = F.col(f"{metric}_{side}")
            outside = outside | (F.col(metric) < limit if side == "low" else F.col(metric) > limit)
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False)))


def quality_rules(docs: DataFrame) -> DataFrame:
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def _sql() -> str:
    shift = "greatest(length(bin(value)) - 6, 0)"
    outside = []
    for metric in METRICS:
        q = f"(SELECT {{}} FROM quantiles q WHERE q.metric = '{metric}' AND q.lang IS NOT DISTINCT FROM m.lang AND q.source IS NOT DISTINCT FROM m.source)"
        if metric in HIGH:
            outside.append(f"{metric} > {q.format('high + (1 << greatest(length(bin(high)) - 6, 0)) - 1')}")
            continue
        lower, slack = SPREAD[metric]
        outside.append(f"{metric} > {q.format(f'q3 + {REACH} * (q3 - q1 + {slack})')}")
        if lower:
            outside.append(f"{metric} < {q.format(f'q1 - {REACH} * (q3 - q1 + {slack})')}")
    pairs = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS metric, {m} AS value FROM metrics WHERE NOT base_failed" for m in METRICS
    )
    return rf"""
    WITH d AS (
      SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)),
                         lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
      FROM documents),
    win AS (
      SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s
      FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
    twice AS (
      SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS b
      FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1),
    rep AS (
      SELECT rid, sum(CASE WHEN b IS NULL THEN {WINDOW} ELSE least({WINDOW}, i - b) END) AS n FROM twice GROUP BY rid),
    c AS (
      SELECT d.rid, doc_id, lang, source, len(w)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN rep USING (rid)),
    metrics AS (
      SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
             1000 * word_chars // greatest(n_words, 1) AS word_millichars,
             1000000 * n_symbols // greatest(word_chars, 1) AS symbol_ppm,
             1000000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_ppm,
             1000000 * n_repeat_words // greatest(n_words, 1) AS repeat_ppm
      FROM c),
    pairs AS ({pairs}),
    buckets AS (
      SELECT lang, source, metric, (value >> {shift}) << {shift} AS bucket, count(*) AS n FROM pairs GROUP BY ALL),
    ranked AS (
      SELECT *, sum(n) OVER (PARTITION BY lang, source, metric) AS a,
             sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS u FROM buckets),
    quantiles AS (
      SELECT lang, source, metric, min(CASE WHEN 4 * u >= a THEN bucket END) AS q1,
             min(CASE WHEN 4 * u >= 3 * a THEN bucket END) AS q3,
             min(CASE WHEN {TAIL} * u >= {TAIL - 1} * a THEN bucket END) AS high FROM ranked GROUP BY ALL)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT coalesce({" OR ".join(outside)}, false) AS kept
    FROM metrics m"""


SQL = _sql()
