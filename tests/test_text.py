import pytest
from pyspark.sql import functions as F

from parlance.functions import emoji as E
from parlance.functions import text as TX
from parlance.operators import preprocess as P
from parlance.resources.phrases import ABBREVIATIONS, PHRASES


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["x"] for r in df.select("i", expr(F.col("c")).alias("x")).orderBy("i").collect()]


def rows(spark, values, **extra):
    data = [(1, i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "chat_id bigint, seq bigint, content string")
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


def contents(df, name="content"):
    return [r[name] for r in df.orderBy("seq").collect()]


def test_tokens_and_strip_follow_unicode(spark):
    values = ["  a b　c\td  ", "", " ", "one", None, "x\x1cy\x85z", "\x0b\x0c"]
    assert column(spark, values, TX.tokens) == [None if v is None else v.split() for v in values]
    assert column(spark, values, TX.strip) == [None if v is None else v.strip() for v in values]


def test_first_link_only(spark):
    values = ["a http://x.y/1?q=é b http://x.y/1?q=é https://z", "no link", "http://", None]
    assert column(spark, values, TX.strip_first_link) == [
        "a é b é https://z", "no link", "http://", None,
    ]


def test_contains_any(spark):
    values = ["HELLO you", "that is g**nd ok", "my  bad", "my bad", "gXXnd", "", None]
    for phrases in PHRASES.values():
        want = [None if v is None else any(p in v.lower() for p in phrases) for v in values]
        assert column(spark, values, lambda c: TX.contains_any(F.lower(c), phrases)) == want
    assert column(spark, ["x"], lambda c: TX.contains_any(c, [])) == [False]


def test_emoji_items(spark):
    text = "hi 😂😂 ok 👍🏽 👨‍👩‍👧 🇮🇳 ❤️ ⏰ a→b ✈️"
    want = ["😂", "😂", "👍🏽", "👨‍👩‍👧", "🇮🇳", "❤️", "⏰", "✈️"]
    assert column(spark, [text, "plain", None, "été :red_heart: :nothing:"], E.items) == [
        want, [], [], ["❤️"],
    ]
    named = column(spark, [text], E.demojize)
    assert named == [
        "hi :face_with_tears_of_joy::face_with_tears_of_joy: ok :thumbs_up_medium_skin_tone: "
        ":man+woman+girl: :flag_in: :red_heart: :alarm_clock: a→b :airplane:"
    ]
    assert column(spark, named, E.emojize) == [text]


def test_every_emoji_name_turns_back(spark):
    table = E.names()
    df = spark.createDataFrame([(e, n) for e, n in table.items()], "e string, n string").select(
        "e", "n", E.demojize(F.col("e")).alias("d"), E.emojize(E.demojize(F.col("e"))).alias("back")
    )
    wrong = [r for r in df.collect() if r["d"] != f":{r['n']}:" or r["back"] != r["e"]]
    assert len(table) > 1300 and len(set(table.values())) == len(table) and not wrong


def test_abbreviations(spark):
    values = ["brb!! ok  asap", "B4 b4", "a.m a.m.", "(u) lol", "", None, "!!"]
    want = ["be right back ok as soon as possible", "B4 before", "a.m a.m.", "you laughing out loud",
            "", None, "!!"]
    assert contents(P.expand_abbreviations(rows(spark, values), ABBREVIATIONS)) == want
    table = spark.createDataFrame(
        [("brb", "be right back"), ("asap", "as soon as possible"), ("b4", "before"),
         ("u", "you"), ("lol", "laughing out loud")], "key string, phrase string")
    assert contents(P.expand_abbreviations(rows(spark, values), dictionary=table)) == want
    many = {f"w{i}": str(i) for i in range(6_000)}
    assert contents(P.expand_abbreviations(rows(spark, ["w5999 x"]), dictionary=many)) == ["5999 x"]


def test_a_large_mapping_is_used_as_a_table(spark, monkeypatch):
    values = ["brb!! ok  asap", "B4 b4", "a.m a.m.", "(u) lol", "", None, "!!"]
    small = contents(P.expand_abbreviations(rows(spark, values), {**ABBREVIATIONS, "a.m": "x"}))
    monkeypatch.setattr(P, "LITERALS", 3)
    plan = P.expand_abbreviations(rows(spark, values), {**ABBREVIATIONS, "a.m": "x"})
    assert contents(plan) == small and "Join" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_tables_meet_the_words_of_a_block_once(spark, monkeypatch):
    """One token a thousand times, many hits in one block, repeated (chat_id, seq), null ids."""
    from parlance.plans import blocks

    monkeypatch.setattr(blocks, "HIT_CELLS", 3)
    table = spark.createDataFrame([(f"w{i}", f"W {i}") for i in range(0, 500, 2)] + [("n", None)], "key string, phrase string")
    texts = [" ".join(["w4"] * 1000), " ".join(f"w{i}" for i in range(500)), "n w2", "", None, "w1"]
    data = [(1, 0, t) for t in texts] + [(None, None, t) for t in texts] + [(c, 7, "w8 x") for c in range(900)]
    df = spark.createDataFrame(data, "chat_id long, seq long, content string").repartition(3)
    out = P.map_tokens_by_table(df, "content", table)
    turn = lambda w: f"W {w[1:]}" if w[0] == "w" and int(w[1:]) % 2 == 0 else w
    want = [(c, s, None if t is None else " ".join(turn(w) for w in t.split())) for c, s, t in data]
    assert sorted(map(str, out.collect())) == sorted(str(r) for r in spark.createDataFrame(want, df.schema).collect())
    assert out.columns == df.columns
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_corrections_equal_brute_force(spark):
    known = {"hello": 5, "help": 9, "hallo": 5, "a": 2, "it": 4, "straße": 3, "winter": 1, "an": 4}
    words = ["helo", "hllo", "hxlpx", "b", "zz", "zzz", "strase", "wintre", "xyzxyz", "hello", "é",
             "helpers", "q", "int", "averyveryverylongword"]
    d = spark.createDataFrame(list(known.items()), "word string, freq bigint")
    w = spark.createDataFrame([(x,) for x in words], "word string")
    got = {r["key"]: r["phrase"] for r in P.corrections(w, d).collect()}
    want = {}
    for x in words:
        near = [(distance(x, k), -f, k) for k, f in known.items() if distance(x, k) <= 2]
        if near and x not in known:
            want[x] = min(near)[2]
    assert got == want


def test_words_of_the_dictionary_stay(spark):
    """Single letters, very long words and words seen once are words like others."""
    text = "a i the pneumonoultramicroscopicsilicovolcanoconiosis once the"
    documents = spark.createDataFrame([(text,)], "text string")
    d = P.word_frequencies(documents)
    df = rows(spark, [text, "a i teh", "q"]).withColumn("language", F.lit("en"))
    assert contents(P.correct_text(df, d)) == [text, "a i the", "q"]


def test_short_words_meet_one_entry(spark):
    """All two-letter words are within two steps of each other; no join gathers them."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    known = spark.createDataFrame([(x + y, 1 + (x + y == "qz")) for x in letters for y in letters], "word string, freq bigint")
    words = spark.createDataFrame([(chr(0x4E00 + i) + chr(0x5E00 + i),) for i in range(200)], "word string")
    got = {r["key"]: r["phrase"] for r in P.corrections(words, known).collect()}
    assert len(got) == 200 and set(got.values()) == {"qz"}


def test_translation_table(spark):
    table = spark.createDataFrame([("les", "the")], "key string, phrase string")
    df = rows(spark, ["les  chats", "les", None, " "]).withColumn("language", F.when(F.col("seq") == 1, "en").otherwise("fr"))
    got = {r["seq"]: r["translated"] for r in P.translate(df, table).collect()}
    want = {r["seq"]: r["translated"] for r in P.translate(df, {"les": "the"}).collect()}
    assert got == want and got[0] == "the chats" and got[1] == "les"


def longest_runs(words, table):
    """Leftmost longest replacement by a plain loop."""
    out, i = [], 0
    while i < len(words):
        ends = [n for n in range(len(words) - i, 0, -1) if " ".join(words[i : i + n]) in table]
        out.append(table[" ".join(words[i : i + ends[0]])] if ends else words[i])
        i += ends[0] if ends else 1
    return " ".join(out)


def test_runs_equal_a_plain_loop(spark, monkeypatch):
    import random

    from parlance.operators.phrases import map_runs_by_table
    from parlance.plans import blocks

    monkeypatch.setattr(blocks, "HIT_CELLS", 3)
    rng = random.Random(8)
    some = lambda n: [rng.choice("abcd") for _ in range(n)]
    table = {" ".join(some(rng.randint(1, 5))): f"<{i}>" for i in range(60)}
    for single in "cd":
        table.pop(single, None)
    texts = [" ".join(some(rng.randint(0, 40))) for _ in range(200)] + ["z z", "a" * 50, None, " ", "a  b\tc"]
    df = rows(spark, texts)
    entries = [(k.replace(" ", "  "), v) for k, v in table.items()] + [("", "no"), (" ", "no"), (None, "no"), ("z", None)]
    d = spark.createDataFrame(entries, "key string, phrase string")
    want = [None if t is None else longest_runs(t.split(), table) for t in texts]
    assert contents(map_runs_by_table(df, "content", d)) == want
    assert contents(map_runs_by_table(df, "content", d, where=F.col("seq") < 0)) == texts
    assert map_runs_by_table(df.limit(0), "content", d).count() == 0
    assert contents(map_runs_by_table(df, "content", d.limit(0))) == [None if t is None else " ".join(t.split()) for t in texts]


def test_translation_of_phrases(spark):
    df = rows(spark, ["les chats noirs dorment", "chats  les", "les chats"]).withColumn(
        "language", F.when(F.col("seq") == 2, "en").otherwise("fr"))
    table = {"les chats noirs": "black cats", "les": "the", "chats": "cats"}
    assert contents(P.translate(df, table), "translated") == ["black cats dorment", "cats the", "les chats"]


def test_correct_text(spark):
    d = spark.createDataFrame([("hello", 5), ("world", 4)], "word string, freq bigint")
    df = rows(spark, ["helo wrld!", "x", "helo  helo", None]).withColumn(
        "language", F.when(F.col("seq") == 2, "hi").otherwise("en"))
    assert contents(P.correct_text(df, d)) == ["hello wrld!", "x", "helo  helo", None]
    with pytest.raises(ValueError):
        P.correct_text(df.drop("language"), d)


def test_stop_words(spark):
    df = rows(spark, ["the The cat the cat", "", None, "le chat und"])
    assert contents(P.remove_stop_words(df)) == ["The cat cat", "", None, "chat"]
    assert len(P.default_stop_words()) > 1000


def test_translation_and_defaults(spark):
    df = rows(spark, ["sab theek", " ", "ok"]).withColumn(
        "language", F.when(F.col("seq") < 2, "hi").otherwise("en"))
    assert contents(P.translate(df, {"theek": "fine"}), "translated") == ["sab fine", None, "ok"]
    d = spark.createDataFrame([("fine", 5)], "word string, freq bigint")
    out = P.clean_text(rows(spark, ["finr day", None], type="text"), d, stop_words=["day"])
    assert [(r["language"], r["content"], r["translated"]) for r in out.orderBy("seq").collect()] == [
        ("en", "fine day", "fine"), ("en", None, None),
    ]


def test_translator_prompt_and_answer(spark):
    from parlance.operators import scoring as S

    prompt = column(spark, ["kya"], S.translation_prompt)
    assert prompt == ["Hinglish:\nkya\n\nEnglish:\n"]
    answers = ["<bos>Hinglish:\nkya\nEnglish:\nwhat\nmore", "else", None]
    assert column(spark, answers, S.translation_answer) == ["what", None, None]


def test_prompts_in_parts(spark):
    from parlance.operators import prompts

    df = rows(spark, [f"m{i}" if i != 4 else None for i in range(10)], sender="A")
    people = spark.createDataFrame([(1, "B"), (1, "A")], "chat_id bigint, participant string")
    got = prompts.prompts(df, people, part_rows=3).where("kind = 'relationships'").orderBy("part")
    pieces = [r["prompt"] for r in got.collect()]
    assert len(pieces) == 4 and " ".join(pieces) == (
        "Analyze the relationships between A, B based on this text: m0 m1 m2 m3 m5 m6 m7 m8 m9"
    )
    assert column(spark, [" a, b, c "], prompts.split_topics) == [["a", "b", "c"]]
