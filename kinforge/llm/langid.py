"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text stands for each language. A document is cut,
left to right, into the longest phrases that occur in that text; a language that
fits needs few phrases. The language with the fewest phrases per symbol wins.

Texts are read as symbols: the LETTERS lower-cased letters most frequent in all
labelled texts together, one symbol for all others, runs of anything but letters as one space. Documents of a
batch are parsed together, one array step a symbol, in lanes of LANE symbols (a
phrase ends where a lane does, for every language alike).

The model is bounded: at most SAMPLE_ROWS labelled rows a language, in order of a
hash of doc_id, of each up to SAMPLE_CHARS code points, in all MODEL_CHARS symbols
a language. Every document is parsed whole.

Defined cases: a text that is null or has no letters is ``und`` with score 0; with
no labelled row at all, so is every text; ties go to the smaller label; null ids
are never learned from and never held out; texts of any length are parsed whole; an
empty table gives an empty result; other columns are carried along, whatever their
names (but those asked for in the result).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .words import blocks

SAMPLE_ROWS, SAMPLE_CHARS, MODEL_CHARS = 64, 2000, 24_000
LANE, LETTERS = 1024, 60
SPACE, OTHER, PAD = 0, 1, 2
SCHEMA = "doc_id long, lang_pred string, score double"


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """The suffix automaton's steps: out[state * width + symbol] = 4 * next state + phrases that end there.

    State 0 is between phrases; a symbol that the text lacks is a phrase of its own.
    """
    link, length, step = [-1], [0], [{}]
    last = 0
    for c in symbols:
        state, p = len(link), last
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        while p >= 0 and c not in step[p]:
            step[p][c] = state
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                twin = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
    out = np.empty((len(link), width), np.int32)
    root = np.zeros(width, np.int32)
    for c, s in step[0].items():
        root[c] = s
    out[:] = 4 * root + np.where(root == 0, 2, 1)
    out[0] -= 1
    for s, steps in enumerate(step):
        for c, to in steps.items():
            out[s, c] = 4 * to
    out[:, PAD] = 4 * np.arange(len(link))
    return out.ravel()


class Model:
    """Automata of all languages; texts: label -> symbols' text."""

    def __init__(self, texts: dict[str, str]):
        self.labels = sorted(texts)
        letters = Counter(c for t in texts.values() for c in t.lower() if c.isalpha())
        self.known = {c: 3 + i for i, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:LETTERS])}
        self.width = 3 + len(self.known)
        self.table = np.full(0x110000, SPACE, np.uint8)
        for code in range(0x30000):
            c = chr(code)
            if c.isalpha():
                self.table[code] = self.known.get(c.lower(), OTHER)
        self.steps = [automaton(self.symbols(texts[x]).tolist()[:MODEL_CHARS], self.width) for x in self.labels]

    def symbols(self, text: str) -> np.ndarray:
        s = self.table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != SPACE) | (s[:-1] != SPACE)
        return s[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each text, and phrases by language and text."""
        parts = [self.symbols(t) for t in texts]
        size = np.array([len(p) for p in parts], np.int64)
        lanes = -(-size // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        grid = np.full((lanes.sum(), LANE), PAD, np.uint8)
        flat, at = grid.reshape(-1), 0
        for p, n in zip(parts, lanes.tolist()):
            flat[at : at + len(p)] = p
            at += n * LANE
        columns = np.ascontiguousarray(grid.T).astype(np.int32)
        filled = (grid != PAD).sum(1)
        order = np.argsort(-filled, kind="stable")
        columns = columns[:, order]
        active = np.searchsorted(-filled[order], -np.arange(LANE), "left")  # lanes with more than t symbols
        out = np.zeros((len(self.labels), len(texts)))
        for k, step in enumerate(self.steps):
            state, ended = np.zeros(len(grid), np.int32), np.zeros(len(grid), np.int32)
            for t in range(LANE):
                n = active[t]
                if not n:
                    break
                to = step.take(state[:n] * self.width + columns[t, :n])
                ended[:n] += to & 3
                state[:n] = to >> 2
            np.add.at(out[k], owner[order], ended + (state > 0))
        return size, out


_models: dict[tuple, Model] = {}


def model_of(texts: dict[str, str]) -> Model:
    """Built once a worker."""
    key = tuple(sorted(texts.items()))
    if key not in _models:
        _models.clear()
        _models[key] = Model(texts)
    return _models[key]


def classify(texts: list[str], model: Model) -> tuple[list[str], list[float]]:
    if not model.labels:
        return ["und"] * len(texts), [0.0] * len(texts)
    size, count = model.phrases(texts)
    rate = count / np.maximum(size, 1)
    best = rate.argmin(0)
    least = rate.min(0)
    other = np.partition(rate, 1, 0)[1] if len(rate) > 1 else least
    sure = other / np.maximum(least + other, 1e-12) if len(rate) > 1 else np.ones(len(texts))
    return [model.labels[b] for b in best], [float(x) for x in np.clip(sure, 0, 1)]


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame) -> dict[str, str]:
    """Text to learn from, by language; bounded as the module says."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = usable.select("lang", F.xxhash64("doc_id").alias("__h"), "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("part")).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= SAMPLE_ROWS)
    texts: dict[str, list] = {}
    for r in picked.select("lang", "__n", "part").collect():
        texts.setdefault(r["lang"], []).append((r["__n"], r["part"]))
    return {k: " ".join(t for _, t in sorted(v))[: 2 * MODEL_CHARS] for k, v in texts.items()}


def identify(docs: DataFrame, learn_from: DataFrame | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted label and its score under names; learns from learn_from (docs themselves)."""
    texts = sample(docs if learn_from is None else learn_from)
    kept = [c for c in docs.columns if c not in names]
    inner = [f"k{i}" for i in range(len(kept))]  # whatever the columns are called
    given = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(kept, inner)])
    schema = given.withColumns({"label": F.lit(""), "score": F.lit(0.0)}).schema
    own = inner[kept.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(texts)
        for batch in batches:
            labels: list[str] = []
            scores: list[float] = []
            column = batch.column(own)
            for low, high in blocks(column):
                rows = [t or "" for t in column.slice(low, high - low).to_pylist()]
                p, s = classify(rows, model)
                labels += p
                scores += s
            seen = batch.column("letters").to_pylist()
            labels = [p if x else "und" for p, x in zip(labels, seen)]
            scores = [s if x and p != "und" else 0.0 for p, s, x in zip(labels, scores, seen)]
            arrays = [batch.column(c) for c in inner] + [pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*inner, "label", "score"])

    return given.withColumn("letters", F.coalesce(F.col(own).rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema).toDF(*kept, *names)
