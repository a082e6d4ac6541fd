"""Small documents with the odd cases every operator must bear: nulls, empty and very long texts, ties, repeats, clashing names."""

import random

WORDS = "alpha beta gamma delta the of and to über côté naïve ñandú straße 東京 x1 don't it's".split()


def text(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", ", ", "\n", "  ", ".\n\n", "\t"]) for _ in range(n))


def odd_docs(spark):
    rows = [(i, text(n, i), "en", f"src{i % 3}", None) for i, n in enumerate([1, 2, 5, 30, 200, 400, 3000])]
    rows += [(100, None, None, None, None), (101, "", "en", "src0", 0), (102, " \n\t ", "fr", None, 3), (103, "a\x1cb \x85 c", "en", "s", 1), (104, "same text here", "en", "s", 1), (104, "same text here", "en", "s", 1), (None, "no id at all", "en", "s", 1), (105, "😀 emoji 👩‍👩‍👧 <|endoftext|> e\u0301", "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def clash(df, *names):
    from pyspark.sql import functions as F

    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df


def key(row):
    return tuple((x is not None, str(type(x)), x) if not isinstance(x, (int, float, str, bool)) else (True, "", x) for x in row)


def same(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))
