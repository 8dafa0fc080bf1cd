"""Ids of unknown words come from the library as one array with places, and stay right when the memo is trimmed."""

from __future__ import annotations

import numpy as np
import public_tokenizers

from fieldframe.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_asked_words_are_places_in_one_array():
    e = token_files.WordEncoder(PATH)
    words = ["river", "x1-y2", "日本語", "ñandú", "zqxv", "a.b,c", "ﬁn", "é́"]
    plain = np.array([True, False, False, True, True, False, False, False])
    ids, place, n = e._ask([w.encode() for w in words], plain)
    assert ids.dtype == np.int32 and len(ids) == n.sum()
    for w, a, k in zip(words, place.tolist(), n.tolist(), strict=True):
        assert ids[a : a + k].tolist() == e.library.encode(w, add_special_tokens=False).ids, w
    ids, place, n = e._ask([], np.zeros(0, bool))
    assert len(ids) == len(place) == len(n) == 0


def test_a_trimmed_memo_keeps_the_words_in_use():
    e = token_files.WordEncoder(PATH)
    e.memo = token_files.Memo(40)
    kept = [f"word{k}" for k in range(12)]
    for turn in range(12):
        words = [*kept, *(f"new{turn}x{k}" for k in range(7))]
        text = " ".join(words)
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = e.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == e.library.encode(text, add_special_tokens=False).ids, turn
    assert e.memo.count <= 40 + 19
