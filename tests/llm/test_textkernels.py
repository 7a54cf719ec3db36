import re

import numpy as np
import pyarrow as pa
from brute import PLAIN, WHITE
from hypothesis import given, settings
from hypothesis import strategies as st

from edgeloom.llm import textkernels as K

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB9é \n\t.\x00|\U0001f600", max_size=40)), max_size=8)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_words_are_the_patterns_matches(texts):
    for table, pattern in ((K.SPACE_SEPARATED, WHITE), (K.ALPHANUMERIC, PLAIN)):
        data, offs = K.text_bytes(pa.array(texts, pa.string()))
        data = K.LOWER[data]
        words = K.find_words(data, offs, table)
        found = [[data[a:b].tobytes().decode() for a, b in zip(words.start[i:j], words.end[i:j], strict=True)] for i, j in zip(words.doc[:-1], words.doc[1:], strict=True)]
        assert found == [re.findall(pattern, data[a:b].tobytes().decode()) for a, b in zip(offs[:-1], offs[1:], strict=True)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=3), max_size=30), st.integers(1, 4))
def test_hashes_tell_words_and_windows_apart(words, size):
    words = [w for w in words if w]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    found = K.find_words(data, np.array([0, len(data)]), K.SPACE_SEPARATED)
    hashes = K.word_hashes(data, found.start, found.end)
    assert len(set(hashes.tolist())) == len(set(words))
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    assert len(set(K.window_hashes(hashes, size).tolist())) == len(set(windows))
    assert K.join_words(data, found.start, found.end).decode() == " ".join(words)


def test_long_words_and_chunks(monkeypatch):
    monkeypatch.setattr(K, "_CHUNK", 8)
    text = "ab " + "x" * 50 + " ab cd ab"
    data = np.frombuffer(text.encode(), np.uint8)
    found = K.find_words(data, np.array([0, len(data)]), K.SPACE_SEPARATED)
    h = K.word_hashes(data, found.start, found.end)
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3


def test_windows_stay_inside_documents():
    doc = np.array([0, 3, 3, 5, 9])
    assert K.windows_inside(doc, 3).tolist() == [True, False, False, False, False, True, True]
    assert K.covered(np.array([False, True, False]), 2, 4).tolist() == [False, True, True, False]


def thue_morse(n):
    """Two words that differ in every letter, which a polynomial hash modulo 2**64 can't tell apart."""
    ones = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in ones), "".join("ba"[x] for x in ones)


def test_words_of_a_regular_build_are_told_apart():
    for n in (8, 64, 256, 1024, 4096):
        a, b = thue_morse(n)
        data = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
        found = K.find_words(data, np.array([0, len(data)]), K.SPACE_SEPARATED)
        h, other = (K.word_hashes(data, found.start, found.end, seed) for seed in (0, 1))
        assert h[0] == h[2] and h[0] != h[1] and h[0] != other[0] and other[0] != other[1]
