import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from beamframe.llm import decontaminate as d
from tests.llm.cases import clash, odd_docs


def distance(item, text):
    """Least edits of item against any part of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=14), st.text("abc", min_size=1, max_size=25))
def test_banded_distance(item, text):
    low, high = -len(item), len(text)
    got = d.banded_distance(d.points(item), d.points(text), low, high, len(item))
    assert got[0] == distance(item, text)
    assert distance(item, text[got[1] : got[2]]) == got[0]


def rand(r, n):
    return "".join(r.choice("abcdefghij éß") for _ in range(n)).strip() or "a"


def edited(r, text, k):
    for _ in range(k):
        i = r.randrange(len(text)) if text else 0
        text = r.choice([text[:i] + text[i + 1 :], text[:i] + "x" + text[i + 1 :], text[:i] + "yy" [: 1] + text[i:]])
    return text


def test_search_by_brute_force(spark):
    r = random.Random(12)
    items = [(i, rand(r, r.choice([3, 5, 8, 12, 15, 20, 23, 30, 31, 60, 100, 160]))) for i in range(45)] + [(90, None), (91, ""), (92, "Short"), (None, "no item id for this one")]
    texts = []
    for i in range(200):
        own = rand(r, r.randint(0, 300))
        if r.random() < 0.7:
            item = r.choice([*items[:45], items[-1]])[1]
            own += " " + edited(r, item.upper() if r.random() < 0.3 else item, r.choice([0, 1, 2, 3, 6, 10, 20])).replace(" ", r.choice([" ", "\n ", "  "])) + " " + rand(r, r.randint(0, 100))
        texts.append((i, own))
    docs = clash(spark.createDataFrame(texts + [(500, None), (501, "")], "doc_id long, text string"), "item_id", "edits")
    bench = clash(spark.createDataFrame(items, "item_id long, text string"), "doc_id")
    rows = d.find_passages(docs, bench).collect()
    got = {(x.doc_id, x.item_id): x.edits for x in rows}
    want = {}
    for i, text in texts:
        t = d.normalize(text)
        for j, item in items:
            n = d.normalize(item)
            k = int(len(n) * d.RATE)
            if n and (e := distance(n, t)) <= k:
                want[i, j] = e
    assert got == want
    by = dict(texts)
    for x in rows:
        assert distance(d.normalize(dict(items)[x.item_id]), d.normalize(by[x.doc_id][x.start : x.end])) <= x.edits + 1
    left = {x.doc_id for x in d.without_passages(docs, bench).collect()}
    assert left == {i for i, _ in texts} - {i for i, _ in want} | {500, 501}


def test_passes_and_empty_tables(spark, monkeypatch):
    r = random.Random(2)
    items = [(i, rand(r, 80)) for i in range(10)]
    docs = spark.createDataFrame([(i, "before " + t + " after") for i, t in items], "doc_id long, text string").union(odd_docs(spark).select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, d.find_passages(docs, bench).collect()))
    assert [x[:3] for x in whole] == [(i, i, 0) for i in range(10)]
    monkeypatch.setattr(d, "MOST_BROADCAST", 200)
    assert sorted(map(tuple, d.find_passages(docs, bench).collect())) == whole
    assert d.find_passages(docs.limit(0), bench).count() == 0 and d.find_passages(docs, bench.limit(0)).count() == 0


def test_places():
    text = "  A b\n\tÇ  "
    norm, at = d.normalized_places(text)
    assert norm == d.normalize(text) and [text[i] for i in at[:-1]][0] == "A"
    assert len(at) == len(norm) + 1 and np.all(np.diff(at) >= 0)
