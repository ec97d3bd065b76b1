import json
import zipfile

from pyspark.sql import functions as F

import letters

from parlance.analyze import analyze
from parlance.resources.phrases import ABBREVIATIONS
from parlance.sources import dictionaries, exports

TEXT = "first\r\nsecond: ünï\n\nfourth" + "".join(f"\nline {i}" for i in range(200)) + "\n"


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name, text in (("a b.txt", TEXT), ("+91 5%20é.v2.txt", "only\n")):
        (tmp_path / name).write_bytes(text.encode())
    want = {("a b", i, t) for i, t in enumerate(TEXT.replace("\r\n", "\n").split("\n")[:-1])}
    want.add(("+91 5%20é.v2", 0, "only"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = [tuple(r) for r in exports.scan_lines(spark, str(tmp_path)).collect()]
            assert len(rows) == len(want) and set(rows) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_zip_exports(spark, tmp_path):
    for who in ("Ann", "+1 5%20"):
        with zipfile.ZipFile(tmp_path / f"Saved Chat with {who}.zip", "w") as z:
            z.writestr("_chat.txt", TEXT)
            z.writestr("photo.jpg", b"\xff\xfe")
    rows = exports.scan_zip(spark, str(tmp_path / "*.zip")).collect()
    lines = TEXT.replace("\r\n", "\n").split("\n")[:-1]
    assert {tuple(r) for r in rows} == {
        (who, i, t) for who in ("Ann", "+1 5%20") for i, t in enumerate(lines)
    }
    small = exports.unzip(spark.read.format("binaryFile").load(str(tmp_path)), batch_lines=7)
    assert small.count() == 2 * len(lines)


def test_damaged_zips_keep_their_beginning_and_are_named(spark, tmp_path):
    """A flipped byte, a truncated file and a wrong checksum stop neither the scan nor the report."""
    lines = [f"line {i} {'é' * (i % 50)} {i * 7919 % 1000}" for i in range(40_000)]
    for name in ("good", "flipped", "truncated", "checksum"):
        with zipfile.ZipFile(tmp_path / f"Saved Chat with {name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("_chat.txt", "\n".join(lines))
    at = tmp_path / "Saved Chat with flipped.zip"
    data = bytearray(at.read_bytes())
    data[len(data) // 2] ^= 0xFF
    at.write_bytes(data)
    at = tmp_path / "Saved Chat with truncated.zip"
    at.write_bytes(at.read_bytes()[:-2000])
    at = tmp_path / "Saved Chat with checksum.zip"
    data = bytearray(at.read_bytes())
    where = data.rindex(b"PK\x01\x02") + 16
    data[where] ^= 0xFF
    at.write_bytes(data)
    found = {}
    for r in exports.scan_zip(spark, str(tmp_path / "*.zip")).collect():
        found.setdefault(r["chat_id"], {})[r["seq"]] = r["line"]
    assert found["good"] == dict(enumerate(lines))
    assert "truncated" not in found and 0 < len(found["flipped"]) <= len(lines) + 40_000
    first = found["flipped"]
    assert [first[i] for i in range(1000)] == lines[:1000]
    assert [found["checksum"][i] for i in range(1000)] == lines[:1000]
    bad = {r["path"].rsplit("%20", 1)[-1].rsplit(" ", 1)[-1] for r in exports.unreadable(spark, str(tmp_path / "*.zip")).collect()}
    assert bad == {"flipped.zip", "truncated.zip", "checksum.zip"}


def test_dictionaries(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"BRB": "Be Right Back",\n "u" : "you", "U": "YOU all"}')
    got = {tuple(r) for r in dictionaries.abbreviations(spark, str(tmp_path / "a.json")).collect()}
    assert got == {("brb", "be right back"), ("u", "you all")}
    (tmp_path / "w.json").write_text(json.dumps({"apology": ["sorry", "my bad"], "x": ["y"]}))
    got = {tuple(r) for r in dictionaries.phrase_lists(spark, str(tmp_path / "w.json")).collect()}
    assert got == {("apology", 0, "sorry"), ("apology", 1, "my bad"), ("x", 0, "y")}


def test_analyze_end_to_end(spark, tmp_path):
    line = "[28/05/24, 1:{:02d}:00 PM] {}: {}"
    said = [(0, "Ann", "sorry brb"), (3, "Ben", "cool cool 😂"), (9, "Ann", "Missed voice call"),
            (12, "Ann", "hello there")]
    (tmp_path / "ann.txt").write_text("\n".join(line.format(*s) for s in said), encoding="utf-8")
    (tmp_path / "few.txt").write_text(line.format(1, "C", "hi") + "\n" + line.format(2, "D", "yo"))
    out = {r["chat_id"]: json.loads(r["j"]) for r in analyze(
        spark, str(tmp_path), "ios", sample_size=2, abbreviations=ABBREVIATIONS,
        load_model=letters.letters(**letters.HEADS),
    ).selectExpr("chat_id", "to_json(struct(*)) AS j").collect()}
    ann = out["ann"]
    assert ann["participants"] == ["Ann", "Ben"]
    overview = ann["chat_stats"]["overview"]
    words = {w["word"]: w["n"] for w in overview["most_used_words_phrases"]}
    assert words == {"cool": 2, "facewithtearsofjoy": 1, "hello": 1, "there": 1}
    assert ann["call_stats"]["most_frequent_call_type"] == "missed_voice_call"
    assert ann["chat_stats"]["deep_analysis"]["sentiment_summary"]
    assert out["few"]["participants"] == ["C", "D"] and "call_stats" not in out["few"]


def test_folder_of_texts_and_zips(spark, tmp_path):
    line = "[28/05/24, 1:00:00 PM] {}: hi"
    (tmp_path / "one.txt").write_text(line.format("A"))
    (tmp_path / "note.md").write_text("no export")
    with zipfile.ZipFile(tmp_path / "WhatsApp Chat - two.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("_chat.txt", line.format("B"))
    with zipfile.ZipFile(tmp_path / "x y z empty.zip", "w") as z:
        z.writestr("other.txt", "x")
    (tmp_path / "x y z bad.zip").write_bytes(b"PK not a zip")
    got = {(r["chat_id"], r["line"]) for r in exports.scan(spark, str(tmp_path)).collect()}
    assert got == {("one", line.format("A")), ("two", line.format("B"))}
    bad = {r["path"].rsplit("/", 1)[1].replace("%20", " "): r["reason"] for r in exports.unreadable(spark, str(tmp_path)).collect()}
    assert set(bad) == {"x y z empty.zip", "x y z bad.zip"}


def test_deep_path_reads_cleaned_text(spark, tmp_path):
    """Translation and stop words count without a spelling dictionary."""
    said = "\n".join(f"[28/05/24, 1:{m:02d}:00 PM] Ann: chat noir the" for m in range(3))
    (tmp_path / "c.txt").write_text(said)
    seen = tmp_path / "seen"

    def load():
        def model(texts):
            seen.write_text(" ".join(texts))
            return {"sentiment": [[0.0] * 5] * len(texts), "emotion": [[0.0] * 28] * len(texts), "toxicity": [[0.0] * 7] * len(texts)}
        return model

    out = analyze(
        spark, str(tmp_path / "c.txt"), "ios", abbreviations={}, load_model=load, stop_words=["the"],
        detect=lambda df: df.withColumn("language", F.lit("fr")), translation={"chat": "cat", "noir": "black"},
    )
    assert out.count() == 1
    assert set(seen.read_text().split()) == {"cat", "black"}


def test_json_fields_are_sorted_at_every_level(spark, tmp_path):
    from parlance.sources import tables

    df = spark.sql(
        "SELECT named_struct('z', 1, 'a', array(named_struct('y', 1, 'b', 2))) AS s, 5 AS k, "
        "CAST(NULL AS STRUCT<q:INT>) AS m"
    )
    tables.write_json(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == (
        '{"k":5,"s":{"a":[{"b":2,"y":1}],"z":1}}'
    )
