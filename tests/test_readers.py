"""Readers against drops with odd names and odd values."""

import json

import pytest

from daytrail.sources import chats, files, history, timeline
from tests.test_sources import AMERICAN, META, NORMAL

GOOD = {"ts": "2024-05-01T10:00:00Z", "ms_played": 5, "master_metadata_track_name": "a"}


@pytest.mark.parametrize(
    "odd",
    [{"ms_played": 1000.0}, {"skipped": "maybe"}, {"offline_timestamp": 1.5}, {"ms_played": {"a": 1}}, {"shuffle": [1]}],
)
def test_an_odd_value_costs_itself_only(spark, tmp_path, odd):
    path = tmp_path / "anna" / "h.json"
    path.parent.mkdir()
    path.write_text(json.dumps([GOOD, GOOD, GOOD, {**GOOD, **odd}, "text", 5, None, {"no": "ts"}]))
    (path.parent / "broken.json").write_text("not json")
    got = history.read_streaming_history(spark, str(tmp_path), owner=r"/([^/]+)/[^/]*$")
    assert got.count() == len(got.collect()) == 4
    assert {r.owner for r in got.collect()} == {"anna"}
    unread = history.unread_files(files.read_contents(spark, str(tmp_path)))
    assert [r.path.rpartition("/")[2] for r in unread.collect()] == ["broken.json"]
    with_file = history.with_source_file(spark, str(tmp_path))
    assert {r.source_file for r in with_file.collect()} == {"h.json"}


def test_odd_timeline_entries(spark, tmp_path):
    good = {"startTime": "2024-03-10T10:00:00.000+01:00", "endTime": "2024-03-10T11:00:00.000+01:00",
            "visit": {"topCandidate": {"placeLocation": "geo:1.5,2.5", "placeID": "p"}}}
    (tmp_path / "t.json").write_text(json.dumps([good, {**good, "visit": "x"}, {"timelinePath": 3}, 7]))
    entries = timeline.read_timeline(spark, str(tmp_path))
    assert entries.count() == len(entries.collect()) == 3
    assert timeline.segments_from_timeline(entries).count() == 1


def test_hidden_and_upper_case_names(spark, tmp_path):
    inbox = tmp_path / "your_facebook_activity" / "messages" / "inbox"
    for name in ("_anna_123456", ".carl_123456", "dora_123456"):
        (inbox / name).mkdir(parents=True)
        (inbox / name / "message_1.json").write_text(json.dumps({**META, "title": name}))
    (tmp_path / "David_12.JSON").write_text(json.dumps({**NORMAL, "participants": ["Me", *[f"P{i}" for i in range(400)]]}))
    (tmp_path / "WhatsApp Chat with Y.TXT").write_text("intro\n" * 60 + AMERICAN)
    (tmp_path / "_chat.txt").write_text(AMERICAN)
    (tmp_path / "_notes.TXT").write_text("Bought milk today.")
    got = chats.read_messages(spark, str(tmp_path))
    by_name = {r.path.removeprefix(f"file://{tmp_path}/").removeprefix(f"file:{tmp_path}/"): r.source_id for r in got.files.collect()}
    assert len(by_name) == 7
    assert [p for p, s in by_name.items() if s is None] == ["_notes.TXT"]
    threads = got.export.threads.collect()
    assert {r.thread for r in threads} >= {"_anna_123456", ".carl_123456", "dora_123456", "David Nvs", "Y"}
    assert len(threads) == 6
    assert got.export.messages.join(got.export.threads.select("thread_key"), "thread_key").count() == got.export.messages.count()


def test_patterns_of_paths(spark, tmp_path):
    for person in ("a", "b"):
        (tmp_path / person).mkdir()
        (tmp_path / person / "x.txt").write_text("line\n")
        (tmp_path / person / "_y.txt").write_text("line\n")
    assert files.read_lines(spark, f"{tmp_path}/*").count() == 4


def test_network_of_each_person(spark, tmp_path):
    for person, mark in (("anna", "your_facebook_activity"), ("bert", "your_instagram_activity")):
        folder = tmp_path / person / mark / "messages" / "inbox" / "x_123456"
        folder.mkdir(parents=True)
        (folder / "message_1.json").write_text(json.dumps(META))
    got = chats.read_messages(spark, str(tmp_path), owner=rf"{tmp_path}/([^/]+)/")
    assert {(r.owner, r.network) for r in got.export.threads.collect()} == {("anna", "messenger"), ("bert", "instagram")}
