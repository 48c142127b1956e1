import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from daytrail.llm import textscan
from daytrail.llm.textscan import LOOSE, Words, pieces, utf8, windows

TEXTS = st.lists(st.none() | st.text(alphabet="aAbZ é\n\t. 　", max_size=12), max_size=8)


def words_of(texts, gaps=None):
    raw, starts, ends = utf8(pa.array(texts, pa.string()))
    out = []
    for i, j in pieces(starts, ends, 6):
        if ends[j - 1] == starts[i]:
            out += [[] for _ in range(i, j)]
            continue
        w = Words(raw, starts[i:j], ends[i:j], *([gaps] if gaps is not None else []))
        for k in range(j - i):
            mine = slice(w.first[k], w.first[k + 1])
            out.append([
                (bytes(raw[a:b]).decode(errors="replace"), h)
                for a, b, h in zip(w.start[mine], w.end[mine], w.hash[mine], strict=True)
            ])
    return out


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_the_regular_ones(texts):
    seen = {}
    for text, found in zip(texts, words_of(texts), strict=True):
        assert [w for w, _ in found] == re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for word, h in found:
            lower = re.sub("[A-Z]", lambda m: m[0].lower(), word)
            assert seen.setdefault(lower, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_text_in_slices(monkeypatch):
    text = " ".join(f"word{i % 97}" for i in range(500))
    whole = [h for _, h in words_of([text])[0]]
    monkeypatch.setattr(textscan, "PIECE", 64)
    textscan._all_powers.cache_clear()
    assert [h for _, h in words_of([text])[0]] == whole
    textscan._all_powers.cache_clear()


def test_loose_words():
    assert [w for w, _ in words_of(["It's (an) Éa-1."], LOOSE)[0]] == ["It", "s", "an", "Éa", "1"]


def test_windows():
    a = np.array([1, 2, 3, 1, 2, 3], np.uint64)
    w = windows(a, 3)
    assert len(w) == 4 and w[0] == w[3] and len(set(w.tolist())) == 3
    assert len(windows(a[:2], 3)) == 0
