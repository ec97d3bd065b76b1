"""Text clean-up: abbreviations, emoji names, spelling, translation, stop words."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import emoji as E
from parlance.functions.text import is_blank, strip, tokens
from parlance.operators.phrases import map_runs_by_table
from parlance.operators.scoring import route_by_language
from parlance.plans.blocks import hit_of, hits_per_block, packed, salted_lookup, salts_of
from parlance.plans.stored import stored
from parlance.schema import KEYS

# Languages with a stop list.
STOP_LANGUAGES = (
    "danish", "dutch", "english", "finnish", "french", "german", "hungarian", "italian",
    "norwegian", "portuguese", "russian", "spanish", "swedish", "turkish",
)


#: Entries of a mapping that may become literals of a plan.
LITERALS = 1_000


def bare(token: Column) -> Column:
    """Token without anything but Latin letters and digits: the key of an abbreviation."""
    return F.regexp_replace(token, "[^a-zA-Z0-9]", "")


def map_tokens(text: Column, table: Mapping[str, str], punctuated: bool = False) -> Column:
    """Replace the tokens found in the table; tokens are rejoined by one space.

    The table travels in the plan: a mapping is in the driver's memory already.  Larger dictionaries
    come as DataFrames (map_tokens_by_table).

    Membership is one hash probe; only hits search the literal map.  With ``punctuated`` a token is
    looked up by its bare form, which is only made for tokens that have punctuation; entries with
    punctuation of their own can then never be reached.
    """
    if punctuated:
        table = {k: v for k, v in table.items() if re.fullmatch("[a-zA-Z0-9]*", k)}
    if not table:
        return F.array_join(tokens(text), " ")
    flat = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def swap(token: Column) -> Column:
        found = F.when(token.isin(*table), F.element_at(flat, token))
        if punctuated:
            key = bare(token)
            found = found.when(
                token.rlike("[^a-zA-Z0-9]"),
                F.when(key.isin(*table), F.element_at(flat, key)).otherwise(token),
            )
        return found.otherwise(token)

    return F.array_join(F.transform(tokens(text), swap), " ")


def map_tokens_by_table(
    rows: DataFrame,
    column: str,
    table: DataFrame,
    key: Callable = lambda t: t,
    where: Column | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """As map_tokens with a table ``key, phrase`` of any size, unique on ``key`` (else Spark reports a
    repeated map key).

    The distinct tokens of a block of rows meet the table once; what it has comes back as one table
    of hits per block, and texts are rewritten where they are.  Tokens are deduplicated before they
    are shuffled, so what moves besides the rows is the vocabulary of the blocks.  Rows failing
    ``where`` keep their text as it is.
    """
    wanted = F.col(column).isNotNull() if where is None else F.col(column).isNotNull() & where
    wanted = F.coalesce(wanted, F.lit(False))
    blocked, blocks = packed(rows, keys, "_block")
    words = blocked.where(wanted).select("_block", F.explode(F.array_distinct(tokens(F.col(column)))).alias("_token"))
    asked = words.distinct().withColumn("key", key(F.col("_token")))
    found = salted_lookup(asked, table.select("key", "phrase"), "key", ["_block"], salts=salts_of(blocks), how="inner")
    hits = hits_per_block(found.where(F.col("phrase").isNotNull()), "_token", "phrase", blocks)
    swapped = F.transform(tokens(F.col(column)), lambda t: F.coalesce(hit_of(F.col("_hits"), t), t))
    mapped = F.when(wanted, F.array_join(swapped, " ")).otherwise(F.col(column))
    return blocked.join(hits, "_block", "left").withColumn(column, mapped).select(*rows.columns)


def expand_abbreviations(
    rows: DataFrame,
    dictionary: Mapping[str, str] | DataFrame,
    column: str = "content",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Replace whole tokens by their phrase; the token's punctuation is lost on a hit.

    There is no default dictionary (``sources.dictionaries.abbreviations`` reads one).  A mapping of
    more than ``LITERALS`` entries is used as a table, which gives the same texts.
    """
    if isinstance(dictionary, DataFrame):
        return map_tokens_by_table(rows, column, dictionary, bare, keys=keys)
    table = {k.lower(): v.lower() for k, v in dictionary.items()}
    if len(table) > LITERALS:
        held = rows.sparkSession.createDataFrame(list(table.items()), "key string, phrase string")
        return map_tokens_by_table(rows, column, held, bare, keys=keys)
    text = F.col(column)
    return rows.withColumn(column, F.when(text.isNotNull(), map_tokens(text, table, punctuated=True)))


def demojize(rows: DataFrame, column: str = "content") -> DataFrame:
    return rows.withColumn(column, E.demojize(F.col(column)))


def preprocess(
    rows: DataFrame,
    dictionary: Mapping[str, str] | DataFrame,
    column: str = "content",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Abbreviations of ``dictionary``, then emoji names."""
    return demojize(expand_abbreviations(rows, dictionary, column, keys), column)


def text_rows(rows: DataFrame, columns: Sequence[str] = ("content",)) -> DataFrame:
    """Rows of type ``text``; without a type column, rows in which all columns are set."""
    if "type" in rows.columns:
        return rows.where(F.col("type") == "text")
    return rows.dropna(subset=list(columns))


def word_frequencies(documents: DataFrame, text: str = "text") -> DataFrame:
    """Spelling dictionary ``word, freq``: every lower-cased token made of letters only."""
    words = documents.select(F.explode(tokens(F.lower(text))).alias("word"))
    return words.where(F.col("word").rlike(r"^\p{L}+$")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def _shorter(word: Column) -> Column:
    """The word with one character left out, for every position."""
    n = F.length(word)
    return F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)),
        ),
    ).otherwise(F.array().cast("array<string>"))


def _deletions(word: Column, distance: int) -> Column:
    """What is left of a word after up to ``distance`` deletions, the word itself and never nothing."""
    layers, last = [F.array(word)], F.array(word)
    for _ in range(distance):
        last = F.array_distinct(F.flatten(F.transform(last, _shorter)))
        layers.append(last)
    return F.array_remove(F.array_distinct(F.concat(*layers)), "")


def _closest(unknown: DataFrame, dictionary: DataFrame, distance: int) -> DataFrame:
    """``key, phrase`` of the words that have an entry within ``distance``.

    Words that leave nothing after the deletions are within the distance of all entries as short as
    they are: the best such entry per length is one row, so the empty string is no join key.
    """
    reach = F.explode(F.sequence(F.length("word") - distance, F.length("word") + distance))
    lengths = dictionary.select(reach.alias("_n")).distinct()
    near = unknown.withColumn("_n", F.length("word")).join(lengths, "_n", "left_semi")
    # numbers meet, which are shorter to shuffle; the distance is checked on the words
    left_of = F.explode(F.transform(_deletions(F.col("word"), distance), lambda s: F.xxhash64(s))).alias("_left")
    left = near.select("word", left_of)
    right = dictionary.select(F.col("word").alias("phrase"), "freq", left_of)
    # a word has some n * n / 2 deletions and Spark counts them as one row: neither side is one to broadcast
    met = (
        left.join(right.hint("merge"), "_left")
        .withColumn("_steps", F.levenshtein("word", "phrase", distance))
        .where(F.col("_steps") >= 0)
        .select("word", F.struct("_steps", (-F.col("freq")).alias("f"), "phrase").alias("_best"))
    )
    # entries of up to ``distance`` letters: no closer one is missed above, so the best of them will do
    short = (
        dictionary.where(F.length("word") <= distance)
        .agg(F.min(F.struct((-F.col("freq")).alias("f"), F.col("word").alias("w"))).alias("_s"))
        .select(F.explode(F.sequence(F.lit(1), F.lit(distance))).alias("_n"), "_s")
        .where(F.col("_s").isNotNull())
    )
    brief = unknown.withColumn("_n", F.length("word")).join(short, "_n").select(
        "word",
        F.struct(
            F.levenshtein("word", F.col("_s.w")).alias("_steps"), F.col("_s.f"), F.col("_s.w").alias("phrase")
        ).alias("_best"),
    )
    schema = "struct<_steps:int,f:bigint,phrase:string>"
    both = met.select("word", F.col("_best").cast(schema).alias("_best")).unionByName(
        brief.select("word", F.col("_best").cast(schema).alias("_best"))
    )
    return both.groupBy(F.col("word").alias("key")).agg(F.min("_best").alias("_best")).select("key", "_best.phrase")


def corrections(words: DataFrame, dictionary: DataFrame, distance: int = 2) -> DataFrame:
    """``key, phrase`` for each distinct word that is not in the dictionary but close to an entry.

    A word that the dictionary has is never changed.  For the others, the nearest entry wins, then
    the more frequent, then the first in alphabet.  Two words within an edit distance share a string
    after that many deletions each, so an equi-join on deletions finds every pair without comparing
    all pairs.  Distances are tried from 1 upwards and a word that is settled asks no further, which
    keeps short words from meeting everything that shares a letter with them.

    Stored words are many times their files in memory, so they meet by merge joins; none is broadcast.
    """
    dictionary = stored(dictionary.select("word", "freq"), "dictionary")  # often counted from texts, read many times
    unknown = stored(words.select("word").distinct().join(dictionary.hint("merge"), "word", "left_anti"), "unknown")
    found = None
    for d in range(1, distance + 1):
        step = stored(_closest(unknown, dictionary, d), "spelling")
        found = step if found is None else found.unionByName(step)
        if d < distance:
            unknown = unknown.join(step.select(F.col("key").alias("word")).hint("merge"), "word", "left_anti")
    return found


def correct_text(
    rows: DataFrame,
    dictionary: DataFrame,
    column: str = "content",
    language: str = "language",
    distance: int = 2,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Correct English rows of more than one character against ``dictionary(word, freq)``.

    Only tokens made of letters are looked at; the rest, and the order, stay.
    """
    missing = [c for c in (column, language) if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    wanted = (F.col(language) == "en") & (F.length(strip(F.col(column))) > 1)
    wanted = F.coalesce(wanted, F.lit(False))
    words = rows.where(wanted).select(F.explode(tokens(F.col(column))).alias("word")).where(
        F.col("word").rlike(r"^\p{L}+$")
    )
    table = corrections(words, dictionary, distance)
    return map_tokens_by_table(rows, column, table.hint("merge"), where=wanted, keys=keys)


def default_stop_words(languages: Sequence[str] = STOP_LANGUAGES) -> list[str]:
    """Union of the stop lists Spark ships; needs a running session."""
    return sorted({w for lang in languages for w in StopWordsRemover.loadDefaultStopWords(lang)})


def remove_stop_words(
    rows: DataFrame, column: str = "content", stop_words: Sequence[str] | None = None
) -> DataFrame:
    """Drop stop words, case-sensitively; other tokens stay, repeats included."""
    words = list(stop_words) if stop_words is not None else default_stop_words()
    remover = StopWordsRemover(
        inputCol="_tokens", outputCol="_kept", stopWords=words, caseSensitive=True
    )
    split = rows.withColumn("_tokens", F.coalesce(tokens(F.col(column)), F.array().cast("array<string>")))
    kept = F.when(F.col(column).isNotNull(), F.array_join("_kept", " "))
    return remover.transform(split).withColumn(column, kept).select(*rows.columns)


def translate(
    rows: DataFrame,
    translation: Column | Mapping[str, str] | DataFrame,
    column: str = "content",
    language: str = "language",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Add ``translated``.  ``translation`` is an expression (such as a scoring UDF on the text), a
    dictionary, or one of any size as a DataFrame ``key, phrase``.

    Entries may have several words; from left to right the longest one is taken."""
    text = F.col(column)
    if isinstance(translation, Mapping) and any(len(k.split()) > 1 for k in translation):
        held = list(translation.items())
        translation = rows.sparkSession.createDataFrame(held, "key string, phrase string")
    if isinstance(translation, DataFrame):
        copied = rows.withColumn("_turned", text)
        wanted = ~is_blank(text)
        turned = map_runs_by_table(copied, "_turned", translation, where=wanted, keys=keys)
        needed = F.when(wanted, F.col("_turned"))
        return turned.withColumn("translated", route_by_language(F.col(language), text, needed)).drop("_turned")
    if not isinstance(translation, Column):
        translation = map_tokens(text, translation)
    needed = F.when(~is_blank(text), translation)
    return rows.withColumn("translated", route_by_language(F.col(language), text, needed))


def clean_text(
    rows: DataFrame,
    dictionary: DataFrame | None = None,
    detect: Callable[[DataFrame], DataFrame] | None = None,
    translation: Column | Mapping[str, str] | DataFrame | None = None,
    default_language: str = "en",
    stop_words: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Text rows with ``language``, corrected ``content`` and stop-word-free ``translated``.

    Without ``dictionary`` nothing is corrected, the other steps are always done.  Without ``detect`` every row has the default language; without ``translation`` the text is used
    as it is.
    """
    found = text_rows(rows)
    found = detect(found) if detect else found.withColumn("language", F.lit(default_language))
    if dictionary is not None:
        found = correct_text(found, dictionary, keys=keys)
    if translation is None:
        found = found.withColumn("translated", F.col("content"))
    else:
        found = translate(found, translation, keys=keys)
    return remove_stop_words(found, "translated", stop_words)
