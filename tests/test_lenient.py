"""Repeated names, fractions, and prose that only looks like a transcript somewhere."""

from pyspark.sql import functions as F

from daytrail.sources import chats, files, history


def test_the_last_of_repeated_names_counts(spark):
    text = '{"ms_played": 1, "a": "x", "ms_played": 2, "b": {"c": 1, "c": 2}}'
    got = spark.range(1).select(files.raw_fields(F.lit(text)).alias("m")).select("m.ms_played", "m.a", "m.b").first()
    assert tuple(got)[:2] == ("2", "x") and got["b"]
    assert spark.range(1).select(files.raw_fields(F.lit("[1]")).alias("m")).first()["m"] is None
    rows = spark.createDataFrame([("f.json", '[{"ts": "2024-01-01T00:00:00Z", "ms_played": 9.5}, {"ts": "t", "ms_played": 1000.0, "ms_played": 7.0}]')], "path string, content string")
    assert [r["ms_played"] for r in history.entries_from_contents(rows).orderBy("ts").collect()] == [9, 7]


def test_prose_with_a_header_far_down_is_no_transcript(spark, tmp_path):
    header = "12/03/2023, 10:15 - Ann: hello"
    prose = [f"Line {i} of a story." for i in range(500)]
    (tmp_path / "readme.txt").write_text("\n".join(prose[:300] + [header] + prose[300:]))
    (tmp_path / "chat.txt").write_text("\n".join([header] + prose[:60]))
    got = {r["path"].rpartition("/")[2]: (r["headers"], r["lines"]) for r in chats.transcript_head(files.read_lines(spark, str(tmp_path))).collect()}
    assert got == {"readme.txt": (0, 40), "chat.txt": (1, 40)}
    messages = chats.read_messages(spark, str(tmp_path)).export.messages
    assert messages.count() == 1
    far = spark.range(1).select(chats.score_chat_text(F.lit("a/readme.txt"), F.lit("\n".join(prose[:50] + [header]))).alias("s")).first()
    assert far["s"] == 0
