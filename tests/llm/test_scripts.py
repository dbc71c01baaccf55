"""Languages in scripts that are told apart although rare letters share a symbol."""

import random

from pyspark.sql import functions as F

from kinforge.llm import langid

SCRIPTS = {"latin": 0x61, "greek": 0x3B1, "cyrillic": 0x430, "armenian": 0x561, "hebrew": 0x5D0, "arabic": 0x627, "devanagari": 0x915, "thai": 0xE01, "georgian": 0x10D0, "hangul": 0xAC00, "kana": 0x3042, "han": 0x4E00}


def test_twelve_scripts_and_two_languages_of_each(spark):
    rng = random.Random(12)
    rows, k = [], 0
    for name, first in SCRIPTS.items():
        for dialect in "ab":
            # both languages of a script have the same letters and other syllables
            syllables = ["".join(chr(first + rng.randrange(22)) for _ in range(rng.randint(2, 3))) for _ in range(40)]
            for _ in range(24):
                text = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(40))
                rows.append((k, text, name + dialect))
                k += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = langid.identify(df.select("doc_id", "text"), learn_from=df.where("doc_id % 3 <> 0")).join(df.select("doc_id", "lang"), "doc_id")
    r = found.where("doc_id % 3 = 0").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("right"), F.count_if(F.substring("lang", 1, 4) == F.substring("lang_pred", 1, 4)).alias("script")).first()
    print(r)
    assert r.n == 192 and r.right >= 0.95 * r.n
