import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from beamframe.llm import jaccard
from beamframe.llm.components import components
from tests.llm.cases import clash, odd_docs


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(docs):
    sets = {}
    for i, t in docs:
        sets[i] = shingles(t)
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def corpus(n=260):
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    common = [r.choice(words) for _ in range(60)]
    seeds = [[r.choice(words) for _ in range(r.choice([3, 5, 8, 30, 120]))] + (common if r.random() < 0.5 else []) for _ in range(40)]
    out = []
    for i in range(n):
        own = list(r.choice(seeds))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            own[r.randrange(len(own))] = r.choice(words)
        if r.random() < 0.2:
            own += [r.choice(words) for _ in range(r.randint(1, 12))]
        out.append((i, (" " if r.random() < 0.5 else "\n\t ").join(w.upper() if r.random() < 0.1 else w for w in own)))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = jaccard.similar_groups(clash(docs, "n", "bits", "token", "label").repartition(3)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(rows)
    assert len(got) == len(rows)


def test_groups_by_brute_force(spark):
    check(spark, corpus() + [(900, None), (901, ""), (902, " \n"), (903, "ONE two"), (904, "one TWO")])


def test_split_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 8)
    monkeypatch.setattr(jaccard, "SALT", 3)
    check(spark, corpus(150))


def test_nothing_is_broadcast_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_BROADCAST", 0)
    monkeypatch.setattr(jaccard, "SALT", 5)
    check(spark, corpus(100))


def test_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "xyz")
    rows = [(1, a), (2, a + " more"), (3, b), (4, b), (3, c), (5, c + " tail"), (2, c), (9, "alone in the world of words"), (9, "alone in the world of words"), (None, b), (None, "no one else has this")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.component_id) for x in jaccard.similar_groups(docs).collect() if x.doc_id is not None)
    assert got == [(1, 1), (2, 1), (2, 1), (3, 1), (3, 1), (4, 1), (5, 1), (9, 9), (9, 9)]
    assert sorted(str(x.component_id) for x in jaccard.similar_groups(docs).collect() if x.doc_id is None) == ["1", "None"]


def test_odd_tables(spark):
    docs = odd_docs(spark)
    rows = jaccard.similar_groups(docs).collect()
    assert len(rows) == docs.count()
    assert jaccard.similar_groups(docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {}

    def top(i):
        while group.setdefault(i, i) != i:
            i = group[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            group[y] = x
    assert got == {i: top(i) for i in group}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=40))
def test_no_link_is_pruned(sets):
    sets = sorted(sets, key=len)
    bits = np.zeros((len(sets), 64), np.uint8)
    for i, s in enumerate(sets):
        bits[i, [hash(v) * 37 % 64 for v in s]] = 1
    tree = jaccard.Tree(np.array([len(s) for s in sets]), np.packbits(bits, axis=1).view(np.uint64))
    label = np.arange(len(sets))
    a, b = jaccard.traverse(tree, tree, (80, 100), label, label, True)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert want <= found


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(100, 900))
def test_bitmaps_of_all_widths_prune_no_link(seed, n):
    r = np.random.default_rng(seed)
    own = [r.integers(0, 1 << 63, int(n * k), dtype=np.uint64) for k in (0.8, 0.9, 1, 1.2, 2)]
    sets = own + [np.unique(np.concatenate([v[: int(len(v) * r.uniform(0.85, 1))], r.integers(0, 1 << 63, int(len(v) * r.uniform(0, 0.2)), dtype=np.uint64)])) for v in own for _ in range(4)]
    sets.sort(key=len)
    bits = pa.array([jaccard.bitmap(v) for v in sets], pa.binary())
    size = np.array([len(v) for v in sets])
    label = np.arange(len(sets))
    linked = lambda i, j: (lambda both: 100 * both >= 80 * (size[i] + size[j] - both))(len(np.intersect1d(sets[i], sets[j])))
    whole = jaccard.trees(size, bits)
    a, b = jaccard.tree_pairs(whole, whole, (80, 100), label, label, True)
    found = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in label.tolist() for j in range(i + 1, len(sets)) if linked(i, j)}
    assert want <= found and len(found) == len(a)
    left, right = label[::2], label[1::2]
    a, b = jaccard.tree_pairs(jaccard.trees(size[left], bits.take(pa.array(left))), jaccard.trees(size[right], bits.take(pa.array(right))), (80, 100), left, right, False)
    assert {p for p in want if p[0] % 2 != p[1] % 2} <= {(min(p), max(p)) for p in zip(left[a].tolist(), right[b].tolist(), strict=True)}
