import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kinforge.llm import ngrams
from kinforge.llm.words import CHUNK, LONG_WORD, NON_ALNUM, one_hash, row_windows, sliding_min, window_hashes, words


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAé \t\n\x0b\x00ß-9", max_size=30)), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = words(pa.array(texts, pa.string()), lower=True)
    got = [[bytes(w.data[s:e]).lower() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.at, w.at[1:])]
    want = [(t or "").encode().lower().split() for t in texts]
    assert got == want
    flat = [x for row in want for x in row]
    hashes = dict(zip(flat, w.hashes.tolist()))
    assert [hashes[x] for x in flat] == w.hashes.tolist() and len(set(hashes.values())) == len(set(flat))


def test_alnum_words_and_given_words():
    w = words(pa.array(["MIT-License, é2"]), lower=True, seps=NON_ALNUM)
    assert w.hashes.tolist() == one_hash(["mit", "license", "é2"]).tolist()


def test_windows():
    w = words(pa.array(["a b c d", "b c d", "x"]))
    at, rows = row_windows(w.counts, w.at, 3)
    h = window_hashes(w.hashes, 3)[at]
    assert rows.tolist() == [0, 0, 1] and h[1] == h[2] != h[0]
    assert sliding_min(np.array([5, 3, 4, 1, 2, 9]), 3).tolist() == [3, 1, 1, 1]


def test_long_words_that_collide_as_polynomials():
    for n in (8, 9, 10, 11, 12):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << n))
        b = a.translate(str.maketrans("ab", "ba"))
        w = words(pa.array([f"x {a} y", f"{b}", f"{a.upper()}"]), lower=True)
        assert w.hashes[1] != w.hashes[3] and w.hashes[1] == w.hashes[4]


def test_one_very_long_text_across_chunks():
    each = [f"w{i}" for i in range(1000)]
    text = " ".join(each * 1300)  # several chunks
    assert len(text) > 5 * CHUNK
    w = words(pa.array(["first", text, "x" * (3 * CHUNK), "last"]))
    hashes = one_hash(each)
    assert w.counts.tolist() == [1, 1_300_000, 1, 1]
    assert (w.hashes[1:1_300_001].reshape(-1, 1000) == hashes).all()
    assert w.hashes[-1] == one_hash(["last"])[0] and w.end[-2] - w.start[-2] == 3 * CHUNK > LONG_WORD


def test_places_are_sorted_as_last_bits_of_keys(monkeypatch):
    calls = []
    argsort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: calls.append(len(a[0])) or argsort(*a, **k))
    draw = np.random.default_rng(5)
    hashes = draw.choice(draw.integers(0, 1 << 64, 3000, np.uint64), 10_000)
    small = draw.integers(0, 1 << 34, 10_000, np.uint64)
    for keys in (hashes, small, hashes[:1], hashes[:0], np.zeros(5, np.uint64)):
        distinct, place, count = ngrams.numbered(keys)
        want = np.unique(keys, return_counts=True)
        assert distinct.tolist() == want[0].tolist() == keys[place].tolist() and count.tolist() == want[1].tolist()
    assert not calls  # numpy finds the order of numbers several times as slowly as it sorts them
    close = np.concatenate([(np.uint64(7) << np.uint64(60)) + draw.integers(0, 50, 10_000, np.uint64), hashes])
    distinct, place, (total,) = ngrams.summed(close, np.full(len(close), 3))
    want = np.unique(close, return_counts=True)
    assert distinct.tolist() == want[0].tolist() == close[place].tolist() and total.tolist() == (3 * want[1]).tolist()
