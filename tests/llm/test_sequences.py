"""Best-fit decreasing packing against plain lists and the tokenizer itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinforge.llm import sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, window):
    """The tightest window by looking at all of them."""
    left = []
    for n in lengths:
        fits = [(r, w) for w, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(window - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(8))
def test_segment_tree_finds_the_tightest_window(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 7, 64, 100, 4096])
    lengths = sorted((rng.randint(1, window) for _ in range(rng.randint(0, 300))), reverse=True)
    found = sequences.best_fit_decreasing(lengths, window)
    assert sorted(i for w in found for i in w) == list(range(len(lengths)))
    assert sorted(window - sum(lengths[i] for i in w) for w in found) == plain_best_fit(lengths, window)


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_every_id_once_with_little_padding(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 33, 34, 35, 63, 64, 65, 130, 1000]) for _ in range(rng.choice([0, 1, 2, 50, 400]))]
    found = sequences.plan(list(range(len(sizes))), sizes, window=64, tolerance=1)
    got = sorted(p for s in found for p in s)
    at = defaultdict(int)
    for row, start, length in got:
        assert start == at[row] and length > 0
        at[row] += length
    assert dict(at) == dict(enumerate(sizes))
    used = [sum(p[2] for p in s) for s in found]
    assert all(64 - 1 <= u <= 64 or u & (u - 1) == 0 for u in used)
    assert all([(row, start, 64)] in found for row, n in enumerate(sizes) for start in range(0, n // 64 * 64, 64))  # full windows first


def test_words_one_by_one_are_encoded_like_whole_texts():
    t = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    pool = ["a", "Don't", "x\x1cy", "z\x85w", "\xa0b", "<|endoftext|>", "A", "́x", "ΑΣ", "가", "ᆨ", "İ", "​q", "12", "ab12", "...", "</w>", "𝔘", "ẹ́", " ", "\t", "\x0b", "\n\n", " ", "'s", "'", "s"]
    rng = random.Random(5)
    texts = ["", " ", "w" * 5000, *["".join(rng.choice([*pool, " "]) for _ in range(rng.randint(1, 40))) for _ in range(400)]]
    got = list(sequences.encode([x.encode() for x in texts], spec, np.dtype("<u4")))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    letters = "".join(map(chr, range(0x21, 0x260)))
    latin = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(5000)]
    got = sequences.encode([" ".join(latin).encode()], spec, np.dtype("<u2"))
    assert np.frombuffer(next(iter(got)), "<u2").tolist() == t.encode(" ".join(latin), add_special_tokens=False).ids


def test_pieces_and_checksums(spark):
    texts = [(1, "one two three"), (2, None), (None, ""), (3, "long words, " * 4000), (3, "long words, " * 4000), (4, "Ende"), (None, "x y")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "row", "ids", "start", "shard", "pieces")}).repartition(3)
    rows = sequences.pack(docs, PATH, with_ids=True).collect()
    t = Tokenizer.from_file(PATH)
    want = sorted((str(d), [*t.encode(x or "", add_special_tokens=False).ids, 2]) for d, x in texts)
    # repeated rows have pieces of their own: the pieces of equal rows make each row once
    pieces, at = defaultdict(list), defaultdict(int)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        pieces[str(r.doc_id), r.doc_tokens].append((r.start, r.ids))
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 4096
    whole = defaultdict(list)
    for d, ids in want:
        whole[d, len(ids)].append(ids)
    assert set(pieces) == set(whole)
    for key, found in pieces.items():
        assert sorted(i for _, ids in found for i in ids) == sorted(i for ids in whole[key] for i in ids)
        for start, ids in found:
            assert any(w[start : start + len(ids)] == ids for w in whole[key])
    assert all(4096 - u <= sequences.TOLERANCE or u & (u - 1) == 0 for u in at.values())


def test_empty_table(spark):
    assert sequences.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
