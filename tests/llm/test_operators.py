"""Defined cases of every operator on small tables, and brute force beside those that SQL cannot express."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinforge.llm import fingerprints, langid, licences, mixing, neardup, ngrams, packing, pages, substrings, topk
from kinforge.llm.scratch import Scratch

LONG = " ".join(f"w{i}" for i in range(400))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, LONG, "en", "a"),
    (2, LONG, "en", "a"),
    (3, LONG.replace("w7 ", "x7 "), "en", "a"),
    (4, "start " + PASSAGE + " end", "de", "a"),
    (5, "other " + PASSAGE + " tail", "de", "b"),
    (6, "", None, "b"),
    (7, None, "en", None),
    (8, "zwei Worte", "de", "b"),
    (8, "zwei Worte", "de", "b"),
    (9, "12345 !!", "en", None),
    (None, LONG, None, "a"),
    (10, "Released under the MIT License. mit license", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    clashing = {c: F.lit(1) for c in ("n", "id", "key", "size", "score", "host", "keys", "hashes", "component", "shard", "words", "u", "v")}
    return df.withColumns(clashing).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text):
    return (text or "").encode().split()


def test_empty_tables(spark, empty):
    assert packing.pack(empty).count() == 0
    assert langid.identify(empty).count() == 0
    assert mixing.mix(mixing.measured(empty)).count() == 0
    assert substrings.dedup(empty).count() == 0
    assert ngrams.score(empty, empty).count() == 0
    assert neardup.link(empty).count() == 0
    assert licences.scan(empty).count() == 0
    assert fingerprints.edited_pairs(empty).count() == 0
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_one_very_long_text(spark):
    """A text of half a million words beside short ones goes whole through every operator."""
    from kinforge.llm import queries

    n = 500_000
    long = " ".join(f"word{i % 60_000}" for i in range(n))
    rows = [(0, "a short text about nothing at all", "en", "a"), (1, long, "en", "a"), (2, long + " end", "en", "b"), (3, "mit license", "de", "b"), (4, "ein kurzer Text", "de", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert packing.pack(df).where("doc_id = 1").agg(F.sum("n_words")).first()[0] == n
    assert {r["doc_id"]: r["__size"] for r in mixing.measured(df).collect()}[2] == n + 1
    gone = {r["doc_id"]: (r["__n_words"], r["__n_removed"]) for r in substrings.dedup(df, with_text=False).collect()}
    assert gone[1] == (n, 0) and gone[2] == (n + 1, n)
    near = {r["doc_id"]: r["component_id"] for r in neardup.link(df).collect()}
    assert near == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4}
    assert {r["doc_id"]: r["n_tokens"] for r in ngrams.score(df, df).collect()}[1] == n + 1
    assert {r["doc_id"]: r["n_words"] for r in licences.scan(df).collect()}[2] == n + 1
    prints = {r["doc_id"]: r["near_next"] for r in fingerprints.edited_pairs(df).collect()}
    assert prints[2] > 0.95 and prints[1] < 0.1
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(df).collect()}[1] == "en"
    assert queries.QUERIES


def test_columns_named_like_the_operators_own(spark):
    names = ("__size", "__key", "__bucket", "__skey", "__taken", "__epochs", "__row", "__n", "__id", "__survivors", "__letters", "__lang", "__n_words", "__n_removed", "__kept_sha256", "a.b")
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, "one " + passage, "en", "a"), (2, "two " + passage + "".join(f" t{i}" for i in range(60)), "en", "b"), (3, "three", "en", None)], "doc_id long, text string, lang string, source string")
    df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in names])
    import corpus_pipeline

    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == df.columns
        docs = docs.persist()
        assert all(r[c] == f"own {c}" for r in docs.collect() for c in names), name
        if name == "substring_dedup":
            assert {r["doc_id"]: r["text"] for r in docs.collect()}[2] == "two" + "".join(f" t{i}" for i in range(60))
    assert packing.pack(docs).count() >= 2


def test_packing_is_whole_and_fits(docs):
    rows = packing.pack(docs, capacities=(64, 128, 200)).collect()
    assert sum(r["n_words"] for r in rows) == sum(len(words(t)) for _, t, *_ in ROWS)
    assert sum(r["bin_id"] is None for r in rows) == 2
    bins = {}
    for r in rows:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    for items in bins.values():
        items.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in items:
            assert r["bin_offset"] == at
            at += r["n_words"]
        assert at == items[0]["bin_used"] <= items[0]["bin_capacity"]
        assert items[0]["bin_capacity"] == min(c for c in (64, 128, 200) if c >= at)


def plan_cost(plan, overhead, attention):
    return sum(packing.cost_of(c, overhead, attention) for c, _ in plan)


def cheapest(lengths, capacities, overhead, attention):
    """The least cost of any way to put the pieces into bins."""
    fit = lambda n: next((packing.cost_of(c, overhead, attention) for c in capacities if c >= n), None)
    best = [float("inf")]

    def place(k, bins):
        if k == len(lengths):
            best[0] = min(best[0], sum(map(fit, bins)))
            return
        for i, used in enumerate(bins):
            if fit(used + lengths[k]) is not None:
                place(k + 1, [*bins[:i], used + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


def test_packing_against_the_cheapest_of_all_plans():
    import random

    r, over, several, exact = random.Random(4), [], 0, 0
    for _ in range(150):
        capacities = tuple(sorted(r.sample(range(4, 40), 3)))
        lengths = sorted((r.randint(1, capacities[-1]) for _ in range(r.randint(1, 7))), reverse=True)
        overhead, attention = r.choice((0, 2, 8)), r.choice((8, 30, 1000))
        plan = packing.pack_shard(lengths, capacities, overhead, attention)
        assert sorted(i for _, items in plan for i in items) == list(range(len(lengths)))
        assert all(c == min(x for x in capacities if x >= sum(lengths[i] for i in items)) for c, items in plan)
        best = cheapest(lengths, capacities, overhead, attention)
        over.append(plan_cost(plan, overhead, attention) / best)
        exact += over[-1] < 1 + 1e-9
        several += len({c for c, _ in plan}) > 1
    assert min(over) > 1 - 1e-9 and max(over) < 1.6 and sum(over) / len(over) < 1.03 and exact > 105 and several > 40


def test_packing_is_never_dearer_than_one_length_at_a_time():
    import random

    r = random.Random(6)
    for _ in range(10):
        lengths = sorted((min(2048, int(r.lognormvariate(5.5, 1.2)) + 1) for _ in range(400)), reverse=True)
        cost = {c: packing.cost_of(c) for c in packing.CAPACITIES}
        own = plan_cost(packing.pack_shard(lengths), packing.OVERHEAD, packing.ATTENTION)
        for c in packing.CAPACITIES:
            single = packing.best_fit(lengths, packing.CAPACITIES, (c,), cost)
            assert own <= sum(cost[min(x for x in packing.CAPACITIES if x >= sum(lengths[i] for i in b))] for b in single) + 1e-6
        assert len({c for c, _ in packing.pack_shard(lengths)}) > 1
    assert packing.pack_shard([3], (4, 10), 0) == [(4, [0])]
    assert sum(1 for _ in packing.sets_to_open(tuple(range(1, 10)))) == 45


def test_packing_spreads_null_ids_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 16)
    rows = [(None, f"text {i} " * (i % 7 + 1)) for i in range(150)] + [(5, "the same row")] * 150
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = Counter(r["bin_id"] >> 32 for r in got)
    assert len(got) == 300 and len(sizes) > 12 and max(sizes.values()) < 45
    assert Counter((r["doc_id"], r["n_words"]) for r in got) == Counter((i, len(t.split())) for i, t in rows)


def test_language_id(spark, docs):
    found = {r["doc_id"]: r for r in langid.identify(docs.drop("score")).collect()}
    assert found[6]["lang_pred"] == found[7]["lang_pred"] == found[9]["lang_pred"] == "und" and found[9]["score"] == 0.0
    assert found[1]["lang_pred"] in ("en", "de") and 0 <= found[1]["score"] <= 1
    assert "n" in docs.columns


def naive_phrases(symbols, text):
    """Phrases of a text by the definition: the longest prefix that occurs in the learned text."""
    n, at = 0, 0
    while at < len(symbols):
        size = 1
        while at + size <= len(symbols) and symbols[at : at + size] in text:
            size += 1
        at += max(1, size - 1)
        n += 1
    return n


def test_cross_parsing_counts_longest_phrases():
    model = langid.Model({"x": "abracadabra alakazam", "y": "hocus pocus fidibus"})
    for text in ("abra kadabra", "hocus abracadabra fidibus", "cus", "a", "zzz aqqa", "q"):
        size, count = model.phrases([text])
        for k, label in enumerate(model.labels):
            learned = {"x": "abracadabra alakazam", "y": "hocus pocus fidibus"}[label]
            assert count[k][0] == naive_phrases(text, learned)
        assert size[0] == len(text)


def test_languages_of_real_shape(spark):
    en = "the cat sat on the mat and the dog was in the house with another dog "
    de = "der hund sitzt auf der matte und die katze ist in dem haus mit einer anderen "
    rows = [(i, " ".join(t.split()[i % 5 :] + t.split()[: i % 5]), lang) for i in range(40) for t, lang in ((en, "en") if i % 2 else (de, "de"),)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df)
    assert got.where("lang_pred <> lang").count() == 0


def test_mixing(docs):
    rows = mixing.mix(mixing.measured(docs)).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["__taken"] <= 2 * r["__size"] and r["__size"] == len(words(r["text"]))
    total = sum(r["__size"] for r in rows)
    assert abs(sum(v[0]["__target"] for v in by.values()) - 1.5 * total) < 1e-6
    for v in by.values():
        assert abs(sum(r["__taken"] for r in v) - v[0]["__target"]) <= max(r["__size"] for r in v)
        assert v[0]["__target"] <= 2 * sum(r["__size"] for r in v) + 1e-9
    again = mixing.mix(mixing.measured(docs.repartition(5))).collect()
    assert Counter((r["doc_id"], r["__taken"]) for r in rows) == Counter((r["doc_id"], r["__taken"]) for r in again)


def test_substrings_against_brute_force(docs):
    got = Counter((r["doc_id"], r["__n_words"], r["__n_removed"], r["__kept_sha256"]) for r in substrings.dedup(docs).collect())
    first = {}
    for i, t, *_ in ROWS:
        w = words(t)
        for p in range(len(w) - 49):
            if i is not None:
                first[tuple(w[p : p + 50])] = min(i, first.get(tuple(w[p : p + 50]), i))
    want = Counter()
    for i, t, *_ in ROWS:
        w = words(t)
        gone = set()
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        kept = [x for k, x in enumerate(w) if k not in gone]
        want[i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    assert got == want


def test_substrings_by_several_doublings(spark):
    import random

    r = random.Random(9)
    shared = [[f"s{k}w{i}" for i in range(n)] for k, n in enumerate((30, 60, 119, 120, 121, 300))]
    rows = []
    for d in range(40):
        w = []
        for _ in range(r.randrange(4)):
            w += [f"o{d}x{r.randrange(50)}" for _ in range(r.randrange(60))] + r.choice(shared)
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (2, 50, 120):
        first, gone = {}, Counter()
        for d, t in rows:
            w = t.split()
            for p in range(len(w) - length + 1):
                first.setdefault(tuple(w[p : p + length]), d)
        for d, t in rows:
            w = t.split()
            gone[d] = len({p + i for p in range(len(w) - length + 1) if first[tuple(w[p : p + length])] < d for i in range(length)})
        assert {x["doc_id"]: x["__n_removed"] for x in substrings.dedup(df, length).collect()} == gone
    assert substrings.lengths(50) == [25, 50] and substrings.lengths(120) == [30, 60, 120] and substrings.lengths(1) == [1]
    assert substrings.dedup(df.where("doc_id = 3")).first()["__n_removed"] == 0


def test_substring_texts(docs):
    got = {r["doc_id"]: r["text"] for r in substrings.dedup(docs).collect()}
    assert got[2] == "" and got[5] == "other tail" and got[1] == LONG and got[7] is None


def naive_links(rows, length, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + length]) for k in range(max(1, len(w) - length + 1))} if w else set()
    parent = {i: i for i in sets if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in parent:
        for b in parent:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sets, {i: find(i) for i in parent}


def test_near_duplicates_against_brute_force(docs):
    sets, parent = naive_links(ROWS, 3, 85)
    rows = neardup.link(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), parent[r["doc_id"]], parent[r["doc_id"]] == r["doc_id"])


def test_a_large_family_of_edits(spark):
    """Copies of one text with 0 to 59 words replaced: most pairs are near the threshold and share table keys."""
    base = [f"b{i}" for i in range(600)]
    rows = []
    for d in range(70):
        w = list(base)
        for e in range(d % 60):
            w[(d * 131 + e * 37) % 600] = f"e{d}x{e}"
        rows.append((d, " ".join(w), None, None))
    _, parent = naive_links(rows, 3, 85)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.link(df).collect()} == parent


def test_families_around_the_bound_of_small_keys(spark):
    """Families of 2 to 20 edits of a text each, where some are linked and some only share keys."""
    import random

    r, rows = random.Random(8), []
    for family, size in enumerate((2, neardup.SMALL - 1, neardup.SMALL, neardup.SMALL + 1, neardup.SMALL + 2, 20)):
        base = [f"f{family}w{i}" for i in range(120)]
        for k in range(size):
            w = list(base)
            for at in r.sample(range(120), r.randrange(8)):
                w[at] = f"e{family}x{k}y{at}"
            rows.append((100 * family + k, " ".join(w), None, None))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for length, percent in ((3, 85), (5, 80)):
        _, parent = naive_links(rows, length, percent)
        assert 6 < len(set(parent.values())) < len(rows)
        assert {r["doc_id"]: r["component_id"] for r in neardup.link(df, length, percent).collect()} == parent


def test_only_a_prefix_of_what_stands_beside_a_centre_becomes_rows(spark):
    """Edits of a text that mostly aren't linked; most share a passage, some come in linked pairs far from the centre."""
    import random

    r, rows = random.Random(4), []
    base, passage = [f"b{i}" for i in range(150)], [f"p{i}" for i in range(20)]
    for k in range(220):
        own = [f"o{k // 2 if k % 10 < 2 else k + 1000}x{i}" for i in range(90)]
        w = base + (passage if k % 4 else []) + own
        if k % 10 == 1:
            w[r.randrange(150)] = f"e{k}"
        rows.append((k, " ".join(w), None, None))
    _, parent = naive_links(rows, 3, 85)
    assert 20 <= sum(parent[d] != d for d in parent) < 120
    search = neardup.Search(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3), 3, 85)
    got = {r["id"]: r["component"] for r in search.components().collect()}
    assert all(got.get(d, d) == c for d, c in parent.items())
    compared = {(r["u"], r["v"]): r for r in spark.read.parquet(search.scratch.path("compared")).collect()}
    made = Counter((r["id"], r["v"]) for r in spark.read.parquet(search.scratch.path("first")).collect())
    assert made == {k: min(len(r["beside"]), r["n"] * 15 // 100 + 1) for k, r in compared.items() if r["beside"]}
    assert 2 * sum(made.values()) < sum(len(r["beside"]) for r in compared.values())


def test_rows_that_share_an_id_give_one_answer(spark):
    rows = [(1, "a b c d e"), (1, "v w x y z"), (2, "v w x y z"), (3, "a b c d e"), (4, "q r s t u")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [Counter(tuple(r) for r in neardup.link(df.repartition(n)).collect()) for n in (1, 3, 5)]
    assert got[0] == got[1] == got[2] and sum(got[0].values()) == 5


def test_licences(docs):
    found = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    assert (found[10]["n_base"], found[10]["first_word"], found[10]["last_word"], found[10]["base_labels"], found[10]["score"]) == (2, 3, 5, "mit", 1.0)
    assert found[1]["labels"] == "" and found[7]["n_words"] == 0 and found[1]["first_word"] is None


def test_licence_spans(spark):
    mit = " ".join(licences.TEMPLATES["mit"].split())
    cut = " ".join(mit.split()[:30] + ["noise"] * 5 + mit.split()[30:])
    rows = [(1, mit), (2, "Header.\n" + cut.upper()), (3, " ".join(mit.split()[:4])), (4, "copy of the software"), (5, "see the mit\tlicensed thing")]
    found = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["labels"] == found[2]["labels"] == "mit" and found[1]["n_base"] == 0 and found[2]["score"] > 0.95
    assert found[3]["labels"] == found[4]["labels"] == found[5]["labels"] == ""


def test_each_notice_has_its_own_label_only():
    import pyarrow as pa

    scanner = licences.Scanner(licences.TEMPLATES, {})
    labels = lambda texts: scanner.scan(pa.array(texts))["labels"]
    names = list(licences.TEMPLATES)
    assert labels(list(licences.TEMPLATES.values())) == names
    notes = ["(c) 2020 someone, " + t.replace(" the ", " the, ", 2) + " and other words of the program" for t in licences.TEMPLATES.values()]
    assert labels(notes) == names
    bsd3, bsd2 = licences.TEMPLATES["bsd-3-clause"], licences.TEMPLATES["bsd-2-clause"]
    assert labels([bsd3 + " filler" * 60 + " " + bsd2, licences.TEMPLATES["gpl"] + " x " + licences.TEMPLATES["isc"]]) == ["bsd-2-clause,bsd-3-clause", "gpl,isc"]
    sentence = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"
    assert labels([sentence, "in no event shall the author be liable", " ".join(bsd2.split()[:60])]) == ["", "", ""]
    lgpl = licences.Scanner(licences.TEMPLATES, licences.PHRASES).scan(pa.array([licences.TEMPLATES["lgpl"]]))
    assert lgpl["labels"] == ["gpl,lgpl"] and lgpl["base_labels"] == ["gpl"]  # the contract's phrase stands in the notice


def test_matching_statistics_and_chains_against_brute_force():
    import random

    r = random.Random(2)
    for _ in range(60):
        templates = [[r.randrange(4) for _ in range(r.randint(3, 14))] for _ in range(3)]
        text = [r.randrange(5) for _ in range(30)]
        text[5:9] = templates[0][:4]
        held = {(tuple(t[i:j])) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        longest = [max((n for n in range(i + 1) if tuple(text[i - n : i]) in held), default=0) for i in range(len(text) + 1)]
        want = {(i, longest[i]) for i in range(len(text) + 1) if longest[i] and (i == len(text) or longest[i + 1] <= longest[i])}
        automaton = licences.Automaton(templates)
        got = set()
        for end, n, state in automaton.matches([c if c < 4 else -1 for c in text]):
            if n:
                got.add((end, n))
                places = [(t, i + n - 1) for t, s in enumerate(templates) for i in range(len(s) - n + 1) if s[i : i + n] == text[end - n : end]]
                assert sorted(automaton.ends[state]) == places
        assert got == want

    scanner = licences.Scanner({"x": "a b c d e f"}, {})

    def most(spans):
        """The best chain by trying all subsets."""
        best = 0
        for mask in range(1, 1 << len(spans)):
            chain = [s for k, s in enumerate(sorted(spans)) if mask >> k & 1]
            total, ok = chain[0][1], True
            for (f, m, a), (g, n, b) in zip(chain, chain[1:]):
                over = max(f + m - g, a + m - b, 0)
                ok &= f < g and a < b and over < n and g - f - m <= licences.GAP and b - a - m <= licences.GAP
                total += n - over
            best = max(best, total * ok)
        return best

    for _ in range(100):
        spans = list({(r.randrange(120), r.randint(5, 20), r.randrange(100)) for _ in range(r.randint(1, 7))})
        chains = list(scanner.chains(spans, 120))
        assert chains[0][0] == most(spans)
        used = [s for _, c in chains for s in c]
        assert len(used) == len(set(used))


def brute_trigrams(learn):
    """Kneser-Ney of order three, trigrams seen once pruned, from dictionaries: (tokens of text, counts, p(third; first two))."""
    end, start = b"<end>", b"<start>"
    tokens = lambda t: [*(t or "").encode().lower().split(), end]
    ones, raw, threes = Counter(), Counter(), Counter()
    for t in learn:
        padded = [start, *tokens(t)]
        ones.update(padded[1:])
        raw.update(zip(padded, padded[1:]))
        threes.update(zip(padded, padded[1:], padded[2:]))
    twos = Counter((b, c) for _, b, c in threes) + Counter({p: c for p, c in raw.items() if p[0] == start})
    cont, follow, kept = Counter(b for _, b in raw), {}, {}
    for (a, _), c in twos.items():
        follow.setdefault(a, []).append(c)
    for (a, b, _), c in threes.items():
        if c > 1:
            kept.setdefault((a, b), []).append(c)
    v = len(ones)
    d3, d2, d1 = (ngrams.discounts([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]) for x in (threes, twos, cont))
    left = sum(d1[min(c, 3)] for c in cont.values()) / max(len(raw), 1)
    single = lambda w: max(cont[w] - d1[min(cont[w], 3)], 0) / len(raw) + left / (v + 1)

    def pair(a, b):
        if a not in follow:
            return single(b)
        total = sum(follow[a])
        return max(twos[a, b] - d2[min(twos[a, b], 3)], 0) / total + sum(d2[min(c, 3)] for c in follow[a]) / total * single(b)

    def triple(a, b, c):
        if (a, b) not in kept:
            return pair(b, c)
        own = threes[a, b, c] if threes[a, b, c] > 1 else 0
        spent = sum(k - d3[min(k, 3)] for k in kept[a, b]) / raw[a, b]
        return max(own - d3[min(own, 3)], 0) / raw[a, b] + (1 - spent) * pair(b, c)

    def whole(t):
        padded = [start, *tokens(t)]
        return math.log10(pair(*padded[:2])) + sum(math.log10(triple(*x)) for x in zip(padded, padded[1:], padded[2:]))

    for a, b in [*kept][:50]:
        assert abs(sum(triple(a, b, w) for w in [*ones, b"new"]) - 1) < 1e-9
    return tokens, ones, whole


def test_ngrams_against_brute_force(docs):
    got = ngrams.score(docs, docs.where("doc_id is null or doc_id % 3 <> 0"), least=2).collect()
    tokens, ones, whole = brute_trigrams([t for i, t, *_ in ROWS if i is None or i % 3])
    n, v = sum(ones.values()), len(ones)
    want = sorted((i is None, i or 0, len(tokens(t)), sum(ones[w] > 0 for w in tokens(t)), n, round(sum(math.log10((ones[w] + 1) / (n + v + 1)) for w in tokens(t)), 6), round(whole(t), 6)) for i, t, *_ in ROWS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want


def test_ngrams_of_recurring_words(spark):
    """A small vocabulary, so that trigrams of every count occur; once with many buckets and pairs that are spread over several."""
    r = random.Random(5)
    texts = [" ".join(r.choices("abcdefghijkl", range(12, 0, -1), k=r.randrange(60))) for _ in range(120)]
    texts += texts[:10] + [None, "", "a", "a a", "unseen words here", "z " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    tokens, ones, whole = brute_trigrams(t for i, t in enumerate(texts) if i % 4)
    want = {i: round(whole(t), 6) for i, t in enumerate(texts)}
    for each in (ngrams.BUCKET_TOKENS, 40):
        got = ngrams.score(df, df.where("doc_id % 4 <> 0"), bucket_tokens=each, least=2)
        assert {r["doc_id"]: round(r["score"], 6) for r in got.collect()} == want


def brute_full_trigrams(learn):
    """Interpolated modified Kneser-Ney of order three with every trigram, from dictionaries: (score of a text, p, seen contexts, words)."""
    tokens = lambda t: ["<start>", *(t or "").lower().split(), "<end>"]
    raw, threes = Counter(), Counter()
    for x in map(tokens, learn):
        raw.update(zip(x, x[1:]))
        threes.update(zip(x, x[1:], x[2:]))
    before = Counter((b, c) for _, b, c in threes)
    twos = {p: k if p[0] == "<start>" else before[p] for p, k in raw.items()}
    ones = Counter(b for _, b in raw)
    d3, d2, d1 = (ngrams.discounts([list(x.values()).count(k) for k in (1, 2, 3, 4)]) for x in (threes, twos, ones))

    def level(counts, d, context, word, lower):
        have = {w[-1]: k for w, k in counts.items() if w[:-1] == context}
        if not have:
            return lower
        return (max(have.get(word, 0) - d[min(have.get(word, 0), 3)], 0) + sum(d[min(k, 3)] for k in have.values()) * lower) / sum(have.values())

    def p(*x):
        one = level({(w,): k for w, k in ones.items()}, d1, (), x[-1], 1 / (len(ones) + 1))
        two = level(twos, d2, x[-2:-1], x[-1], one)
        return level(threes, d3, x[:-1], x[-1], two) if len(x) > 2 else two

    def score(t):
        x = tokens(t)
        return math.log10(p(*x[:2])) + sum(math.log10(p(*y)) for y in zip(x, x[1:], x[2:]))

    return score, p, {x[:2] for x in threes}, ones


def test_trigrams_seen_once_count_in_full(spark):
    """With least = 1 no trigram is pruned: ends in a bigram seen once, starts with one, does neither, or both; repeated texts stand out."""
    r = random.Random(11)
    texts = [" ".join(r.choice("abcdefgh") if r.random() < 0.7 else f"w{r.randrange(60)}" for _ in range(r.randrange(14))) for _ in range(40)]
    texts += [texts[3], None, "a", "A a b", "w1 w2 w3 w4 w5", "unseen words here", "z " * 30, "q1 q2 q3 q4 q5 q6"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    score, p, contexts, words = brute_full_trigrams([t for i, t in enumerate(texts) if i % 4])
    for a, b in sorted(contexts)[:20]:
        assert abs(sum(p(a, b, w) for w in [*words, "new"]) - 1) < 1e-9
    want = {i: round(score(t), 6) for i, t in enumerate(texts)}
    for each in (ngrams.BUCKET_TOKENS, 40):
        full = {r["doc_id"]: round(r["score"], 6) for r in ngrams.score(df, df.where("doc_id % 4 <> 0"), bucket_tokens=each, least=1).collect()}
        assert full == want
    pruned = {r["doc_id"]: round(r["score"], 6) for r in ngrams.score(df, df.where("doc_id % 4 <> 0"), least=2).collect()}
    assert full[47] > pruned[47]  # learned from, and seen nowhere else


def test_the_query_scores_with_every_trigram(spark, tmp_path):
    import zlib

    texts = ["one two three four", "two three five", "one two six", "seven eight nine", "two three four"] * 2 + ["red green blue", "one two nine four", "two six seven"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    score, *_ = brute_full_trigrams([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2])
    from kinforge.llm import queries

    got = {r["doc_id"]: round(r["score"], 6) for r in queries.op6_lm_scoring(spark, str(tmp_path)).collect()}
    assert got == {i: round(score(t), 6) for i, t in enumerate(texts)}


def test_frequent_words_are_spread_and_missing_files_are_an_error(spark, tmp_path):
    import glob
    import os

    import numpy as np
    import pyarrow as pa

    rows = [(i, " ".join(f"the n{i * 40 + k}" for k in range(40))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    buckets = ngrams.dealt(df, 50)
    the = ngrams.words(pa.array(["the"])).hashes[0]
    spread = dict(zip(buckets.frequent.tolist(), buckets.spread.tolist()))
    assert spread[int(the)] == 50 and len(spread) < 5
    now = np.arange(5000, dtype=np.uint64)
    counts = np.bincount(buckets.of(np.full(5000, the), now), minlength=50)
    assert counts.min() > 50 and counts.max() < 160
    assert len(set(buckets.of(now[:1].repeat(100), now[:100]).tolist())) == 1
    folder, *made = ngrams.train(df, Scratch(spark, "ngrams"), least=2)
    some = pa.array([" ".join(f"the n{k}" for k in range(2000))])
    want = [x.tolist() for x in ngrams.Model(folder, *made).score(some)]
    few = ngrams.Model(folder, *made)
    few.MAPS = 2
    assert [x.tolist() for x in few.score(some)] == want
    os.remove(glob.glob(f"{folder}/pairs-*.0.npy")[0])
    with pytest.raises(FileNotFoundError):
        ngrams.Model(folder, *made).score(some)


def test_nothing_to_learn_from(docs, empty):
    assert all(abs(r["score"]) < 1e-9 for r in ngrams.score(docs, empty).collect())


def test_discounts_without_counts():
    assert ngrams.discounts([0, 0, 0, 0]) == [0.0, 0.5, 1.0, 1.5]


def test_top_k_against_brute_force(spark):
    import random

    r = random.Random(5)
    rows = [(i, [r.choice((-1.0, -0.5, 0.0, 0.25, 1.0)) for _ in range(8)]) for i in range(300)]
    rows += [(300, None), (301, []), (302, [1.0, None]), (303, [float("nan")] * 8), (304, [1.0] * 3), (None, [1.0] * 8), (305, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.search(df, F.col("vec_id") % 20 == 0, 5).collect()}
    ints = {i: [math.floor(64 * x) for x in v] for i, v in rows[:300]}
    for q in range(0, 300, 20):
        best = sorted((-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in ints if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert len(got) == 15 * 5
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert topk.search(few, F.col("vec_id") % 20 == 0).count() == 1


def test_top_k_prunes_before_rows_are_shuffled(spark):
    import numpy as np

    g = np.random.default_rng(7)
    centres = g.normal(0, 20, (24, 6))
    x = centres[g.integers(0, 24, 2400)] + g.normal(0, 0.3, (2400, 6))
    x[2000:2200] = x[2000]  # a common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2400 + i, [float(i), 1.0]) for i in range(30)] + [(2440, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = topk.Search(df, F.col("vec_id") % 20 == 0, 20, row_block=128, query_block=16, cell_rows=64)
    got = {}
    for r in made.result.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = [np.floor(64 * np.array(v)) for _, v in rows]
    for q in range(0, len(rows), 20):
        same = [(i, int(ints[q] @ ints[k])) for k, (i, v) in enumerate(rows) if i != rows[q][0] and len(v) == len(ints[q])]
        best = sorted(same, key=lambda t: (-t[1], t[0]))[:20]
        assert sorted(got.get(rows[q][0], [])) == [(n + 1, i, s) for n, (i, s) in enumerate(best)]
    assert made.share < 0.5


def test_dual_tree_prunes_and_is_exact():
    import numpy as np

    g = np.random.default_rng(1)
    centres = g.integers(-800, 800, (30, 6))
    x = (centres[g.integers(0, 30, 3000)] + g.integers(-20, 20, (3000, 6))).astype(float)
    tree = topk.DualTree(x[:200], np.arange(200), x, np.arange(3000), 10)
    tree.search(leaf=32)
    count = lambda n: sum(map(count, n.children)) or 1
    leaves = count(topk.cover_tree(x[:200], 32)) * count(topk.cover_tree(x, 32))
    full = x[:200] @ x.T
    full[np.arange(200), np.arange(200)] = -np.inf
    for i in range(200):
        order = np.lexsort((np.arange(3000), -full[i]))[:10]
        assert tree.ids[i].tolist() == order.tolist()
    assert tree.visited < 0.7 * leaves


def test_fingerprints_against_the_definition(docs):
    rows = fingerprints.edited_pairs(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    texts = {i: t or "" for i, t, *_ in ROWS if i is not None}
    ids = sorted(texts, reverse=True)
    prints = {}
    for r in rows:
        t, following = texts[r["doc_id"]], texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints[r["doc_id"]] = r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len(rows) == len(ids) and prints[1] == prints[2] != prints[3] and prints[6] == prints[7] == ""
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["near_next"] == 1.0 and by[3]["near_next"] > 0.9 and by[7]["near_next"] == 1.0


def test_fingerprints_of_repeated_and_single_rows(docs, spark):
    assert fingerprints.edited_pairs(docs).count() == len(ROWS)
    one = fingerprints.edited_pairs(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_sketches_against_brute_force():
    """One hash a shingle, the least value of each bin, empty bins filled by their own sequence of donors."""
    import numpy as np
    import pyarrow as pa

    texts = ["", None, "one", "a b c d e f g h", " ".join(f"w{i}" for i in range(300)), "A b C d e f G h"]
    low, some = fingerprints.sketches(pa.array(texts))
    hashes, rows = fingerprints.shingles(pa.array(texts), fingerprints.SHINGLE)
    for r in range(len(texts)):
        own = [int(h) for h, x in zip(hashes, rows) if x == r]
        assert some[r] == bool(own)
        if not own:
            continue
        bins = {}
        for h in own:
            bins[h >> 56] = min(bins.get(h >> 56, 1 << 60), h & ((1 << 56) - 1))
        full = []
        for b in range(fingerprints.BINS):
            t = 0
            while b not in bins and int(fingerprints._donors[t, b]) not in bins:
                t += 1
            full.append(bins[b] if b in bins else bins[int(fingerprints._donors[t, b])])
        want = fingerprints.mix(np.array(full, np.uint64)) & np.uint64((1 << fingerprints.BITS) - 1)
        assert low[r].tolist() == want.tolist()
    assert low[3].tolist() == low[5].tolist()
    prints = fingerprints.packed(low, some)
    assert prints[0] == "" and [int(c, 16) for c in prints[4]] == low[4].tolist()


def test_fingerprints_over_partitions_without_rows(spark):
    rows = [(i, f"text {i} " * (i + 1)) for i in range(9)] + [(None, "n"), (None, None)]
    found = fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()
    texts = [t for _, t in sorted(rows[:9], reverse=True)] + ["", "n"]
    halves = [len(t) // 2 for t in texts]
    want = [hashlib.sha256((t[: len(t) - h] + u[:h]).encode()).hexdigest() for t, u, h in zip(texts, texts[1:] + texts[:1], halves)]
    assert Counter(r["edited_sha256"] for r in found) == Counter(want)


def test_likeness_estimates_similarity():
    import numpy as np
    import pyarrow as pa

    g, errors = np.random.default_rng(3), []
    for _ in range(30):
        a = [f"w{x}" for x in g.integers(0, 10**9, 400)]
        b = a[:300] + [f"w{x}" for x in g.integers(0, 10**9, 100)]
        low, some = fingerprints.sketches(pa.array([" ".join(a), " ".join(b)]))
        x, y = ({tuple(t[i : i + 5]) for i in range(396)} for t in (a, b))
        errors.append(float(fingerprints.likeness(low[:1], low[1:], some[:1], some[1:])[0]) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.15


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header>Site</header><nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">Cookies!</div><!-- x --><div class='ad'>Buy</div>
<article><h1>Head&amp;line</h1><p>One  <b>bold</b>
text<p>Two &lt;3 <i>x</i>y<form>name <input></form><div class="share">Share</div><section id="comments"><p>Nice!</p></section></article>
<aside>More</aside><footer>&copy; me</footer></body></html>"""


def test_pages(spark):
    plain = "<body><div><p>Menu of the site</p><p>{}</p></div><p>Story {} here</p></body>"
    rows = [(0, "http://x.org/a", PAGE), (1, None, None), (2, "", ""), (3, "http://x.org", "just < text & more"), (None, "u", "<p>a</p><p>b"), (3, "http://x.org", "just < text & more")]
    rows += [(10 + i, f"https://Y.org:80/{i}", plain.format(f"Lead {i}", i)) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("keys", F.lit(1))
    found = {r["page_id"]: r for r in pages.extract(df).collect()}
    assert found[0]["text"] == "Head&line\nOne bold text\nTwo <3 xy" and found[0]["n_chars"] == len(found[0]["text"])
    assert found[1]["text"] == found[2]["text"] == "" and found[3]["text"] == "just < text & more" and found[None]["text"] == "a\nb"
    assert found[12]["text"] == "Lead 2\nStory 2 here"
    assert pages.extract(df).count() == len(rows)


def test_headers_inside_and_outside_an_article():
    page = '<body><header><h1>Site</h1></header><article class="post side-note"><header class="post-header"><h1>Title</h1></header><p>Text</p><p hidden>no</p><div class="reader-comments"><p>c</p></div></article></body>'
    assert pages.main_text(page) == "Title\nText"
    assert pages.main_text("<header>Site</header><p>Text<div style='display: none'>no</div>") == "Text"


def test_wrappers_named_like_noise_keep_their_article():
    article = "<article class='post has-comments'><p>Text</p></article>"
    for wrapper in ("class='layout has-sidebar'", "id=no-comments", "class=sidebar"):
        assert pages.main_text(f"<body><nav>n</nav><div {wrapper}>{article}</div></body>") == "Text"
        assert pages.main_text(f"<body><div {wrapper}><div><main><p>Text</p></main></div></div><p>Outside</p></body>") == "Text"
        assert pages.main_text(f"<body><main><div {wrapper}>{article}</div></main></body>") == "Text"
    assert pages.main_text("<body><div class=sidebar><article><p>Text</p></article></div><p>Outside</p></body>") == "Text"
    assert pages.main_text(f"<body>{article}<div id=comments><article class=comment-body>no</article></div></body>") == "Text"
    assert pages.main_text("<body><p>Text</p><div id=comments><article class=comment-body>no</article></div></body>") == "Text"


def test_quoted_articles_stay(spark):
    rows = [(i, "http://z.org/x", f"<body><nav>n</nav><article><p>Shared line</p><p>Own {i}</p></article></body>") for i in range(10)]
    found = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"Shared line\nOwn {r['page_id']}" for r in found)


def test_templates_of_a_section_go_on_a_hot_host(spark):
    rows = [(i, f"http://hot.org/{'news' if i < 8 else 'wiki'}/{i}", f"<body>{'<p>Menu of news</p>' if i < 8 else ''}<p>Story {i}</p></body>") for i in range(1000)]
    found = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Story {i}" for i in range(1000))


def test_recurring_containers_inside_articles_go(spark):
    page = "<body><article><h1>T</h1><p>Own text {0} {0} {0} {0} {0}</p><div class='x7'><p>Get our <b>letter</b></p></div><p>Shared line</p><div>Kept {0}</div></article></body>"
    copy = "<body><article><p>Print {}</p><div><p>The same long text under every address of the host</p></div></article></body>"
    rows = [(i, f"http://z.org/{i}", page.format(i)) for i in range(10)] + [(20 + i, f"http://few.org/{i}", page.format(i)) for i in range(4)]
    rows += [(30 + i, f"http://copies.org/{i}", copy.format(i)) for i in range(8)] + [(40 + i, f"http://one.org/{i}", page.format(1)) for i in range(8)]
    found = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = lambda i: f"T\nOwn text {i} {i} {i} {i} {i}\n"
    assert all(found[i] == f"{own(i)}Shared line\nKept {i}" for i in range(10))
    assert all(found[20 + i] == f"{own(i)}Get our letter\nShared line\nKept {i}" for i in range(4))
    assert all(found[30 + i] == f"Print {i}\nThe same long text under every address of the host" for i in range(8))
    assert all(found[40 + i] == f"{own(1)}Get our letter\nShared line\nKept 1" for i in range(8))


def test_templates_against_a_brute_force_counter(spark):
    """Pages without article tags: what stands on five pages of a host goes, whatever it is called."""
    import random

    r, rows = random.Random(3), []
    shared = [(f"<section><h3>Box {k}</h3><ul><li>Item {k}</li><li>More <b>{k}</b></li></ul></section>", f"Box {k}\nItem {k}\nMore {k}") for k in range(40)]
    for i in range(160):
        parts = [r.choice(shared[(i % 3) * 10 : (i % 3) * 10 + 20]) for _ in range(r.randrange(5))]
        parts += [(f"<div><p>Own {i} {k}</p></div>", f"Own {i} {k}") for k in range(3)]
        r.shuffle(parts)
        rows.append((i, f"https://h{i % 3}.org/{i}", "<body>" + "".join(h for h, _ in parts) + "</body>", parts))
    count = Counter((u.split("/")[2], p) for _, u, _, parts in rows for p in set(parts))
    df = spark.createDataFrame([x[:3] for x in rows], "page_id long, url string, html string")
    found = {x["page_id"]: x["text"] for x in pages.extract(df).collect()}
    kept = 0
    for i, u, _, parts in rows:
        stay = [p for p in parts if count[u.split("/")[2], p] < pages.MIN_PAGES]
        kept += len(stay) - 3
        assert found[i] == "\n".join(t for _, t in stay)
    assert kept > 0 and any(n >= pages.MIN_PAGES for n in count.values())


def test_deep_and_broken_pages_take_time_by_their_length():
    import time

    began = time.time()
    cases = ["<div>" * 16000 + "x", "<b>" * 8000 + "</i>" * 8000, "<i><div>" + "<b>" * 8000 + "</i>" * 8000, "<b>" * 8000 + "<hr>" * 8000, "<main>" * 16000 + "x", "<div class=sidebar>" * 4000 + "<main></main>" * 8000, '<a "x' * 12001 + ">", "<!" * 30000]
    for page in cases:
        pages.main_text(page, {1})
    assert time.time() - began < 4
    assert pages.main_text("<div>" * 3000 + "x") == "x"
    assert pages.main_text("<p>one<br>two <br/> three</p><br><p>four") == "one two three\nfour"
    assert pages.main_text("<table><tr><td>a<td>b<tr><td>c</table><p>d<p>e") == "a\nb\nc\nd\ne"
    assert pages.main_text("<article><p>" + "long text " * 200_000 + "</p></article>") == ("long text " * 200_000).strip()


def test_held_out_is_crc(docs):
    for r in docs.select("doc_id", langid.held_out().alias("h")).collect():
        assert r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_scratch_tables_can_be_dropped(spark):
    s = Scratch(spark, "t")
    assert s.keep(spark.range(3), "a").count() == 3
    s.drop("a")
