"""Appending many batches: few folders are opened, months are merged, repeats change nothing."""

import datetime as dt
from pathlib import Path

import pytest

from daytrail.sources import batches, chats

MESSAGE = "network string, thread string, timestamp timestamp_ntz, date date, sender string, text string"


def lot(spark, numbers, month=1):
    rows = [
        ("n", f"t{i % 3}", dt.datetime(2024, month, 1 + i % 28, 0, 0, i % 60), dt.date(2024, month, 1 + i % 28), "s", None if i % 5 == 0 else f"m{i}")
        for i in numbers
    ]
    return spark.createDataFrame(rows, MESSAGE).coalesce(1)


def texts(spark, path):
    return sorted(map(str, (tuple(r)[:6] for r in spark.read.parquet(path).select("network", "thread", "timestamp", "date", "sender", "text").collect())))


def test_many_batches_open_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "MOST", 4)
    path, opened, listed = str(tmp_path / "t"), [], []
    size = 25
    for k in range(14):
        numbers = range(k * size, (k + 1) * size)
        opened.append(len(chats.append_messages(spark, path, lot(spark, numbers), batch=f"b{k:02d}")))
        listed.append(len(list(Path(path, "_log", "month=2024-01").iterdir())))
    assert max(opened) <= 1 and sum(opened) <= 3  # a key by chance
    assert max(listed) <= 4
    want = texts(spark, path)
    assert len(want) == 14 * size
    # Sent again: the folder that holds the keys is opened, unless it is the batch's own; nothing is added.
    for k in (0, 13, 5):
        held = chats.append_messages(spark, path, lot(spark, range(k * size, (k + 1) * size)), batch=f"b{k:02d}")
        assert held or k == 13
    assert texts(spark, path) == want
    assert chats.append_messages(spark, path, lot(spark, range(9), 2)) == []  # another month


def test_a_merge_that_breaks_off_is_finished_later(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "MOST", 2)
    path = str(tmp_path / "t")
    for k in range(2):
        chats.append_messages(spark, path, lot(spark, range(k * 10, k * 10 + 10)), batch=f"b{k}")
    with monkeypatch.context() as broken:
        def fail(*_):
            raise OSError("gone")

        broken.setattr(batches, "_remove", fail)
        with pytest.raises(OSError):
            chats.append_messages(spark, path, lot(spark, range(20, 30)), batch="b2")
    assert len(texts(spark, path)) == 60  # both the parts and the whole are there for now
    opened = chats.append_messages(spark, path, lot(spark, range(25, 40)), batch="b3")
    assert len(texts(spark, path)) == 40
    assert len(opened) == 1 and "merged-" in opened[0]


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    assert chats.append_messages(spark, path, lot(spark, range(3)).limit(0)) == []
    assert chats.append_messages(spark, path, lot(spark, range(3))) == []
    assert len(texts(spark, path)) == 3
