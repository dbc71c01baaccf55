"""Groups in which much is alike and little is linked."""

import random

from kinforge.llm import neardup
from kinforge.llm.scratch import Scratch


def halves(n, seed=3):
    """One text of 4,000 words, n documents that are each half of its blocks of 100 words, and a few close copies of some."""
    rng = random.Random(seed)
    text = [[f"w{i}" for i in range(k, k + 100)] for k in range(0, 4000, 100)]
    rows = [(0, [w for b in text for w in b])]
    for i in range(1, n + 1):
        rows.append((i, [w for b in sorted(rng.sample(range(40), 20)) for w in text[b]]))
    for i in range(1, 6):
        words = list(rows[i][1])
        for _ in range(10 * i):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        rows.append((n + i, words))
    return [(i, " ".join(w)) for i, w in rows]


def components_of(rows, percent):
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in rows)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_parts_of_one_text_are_not_compared_with_each_other(spark, monkeypatch):
    """Pairs that are compared grow no faster than the documents, and every link is found."""
    counted = {}
    real = Scratch.keep

    def keep(self, df, name, **options):
        out = real(self, df, name, **options)
        if name == "pairs3":
            counted[size] = out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", keep)
    for size in (60, 240):
        rows = halves(size)
        found = {r.doc_id: r.component_id for r in neardup.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
        assert found == components_of(rows, 85) and len(set(found.values())) < len(found)
    assert counted[240] <= 4 * max(counted[60], 20)


def test_finer_keys_are_many_enough():
    for percent in (30, 60, 80, 85, 95, 100):
        keys, rows = neardup.finer_for(percent)
        assert (1 - (percent / 100) ** rows) ** keys <= neardup.MISS and (keys <= neardup.FINER or rows == 1)


def test_few_shingles_are_ranked_before_the_shuffle(spark):
    df = spark.createDataFrame([(i, f"a b c d e f g h w{i % 7}") for i in range(30)], "doc_id long, text string")
    search = neardup.Search(df, 3, 85)
    group = spark.createDataFrame([(1, 2, [1, 2, 3])], "id long, v long, beside array<long>")
    import kinforge.llm.neardup as module

    plans = []
    real = Scratch.keep
    search.scratch.keep = lambda d, name, **o: plans.append(d._jdf.queryExecution().executedPlan().toString()) or real(search.scratch, d, name, **o)
    search.later(group)
    assert "WindowGroupLimit" in plans[0] and module.FREQUENT < 1000
