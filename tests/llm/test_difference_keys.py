"""Near copies that do not link meet on few keys of what they differ in from a leader."""

from daytrail.llm import ngram_join
from tests.llm.test_crowded_keys import copies
from tests.llm.test_language_and_join import brute, joined


def test_copies_with_edits_of_their_own_meet_on_no_key(spark, monkeypatch):
    met = []
    plain = ngram_join.difference_keys

    def counted(differing):
        keys = plain(differing)
        per_key = keys.groupBy("key").count()
        met.append(per_key.selectExpr("coalesce(sum(count * (count - 1) / 2), 0) AS n").first()["n"])
        return keys

    monkeypatch.setattr(ngram_join, "difference_keys", counted)
    monkeypatch.setattr(ngram_join, "boundary", lambda *_: -1)  # lists only
    monkeypatch.setattr(ngram_join, "CROWD", 2)
    rows = copies(160, edits=(5, 6))
    assert joined(spark, rows) == brute(rows)
    assert met and met[0] < 160 * 10  # 12,720 pairs share nearly all their rare shingles
