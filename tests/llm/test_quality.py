import collections
import random
import re

import numpy as np

from beamframe.llm import quality
from tests.llm.cases import clash, odd_docs


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_counts_by_brute_force(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice("ab#c|<x" ) * r.randint(1, 2) for _ in range(n)).replace(" b ", r.choice(["\n", " b\n", "  "])) for n in (3, 10, 50, 200, 1000) for _ in range(6)]
    texts += ["a b c a b c", "a a a a", "x\n\nx\n \n x", "a b c d a b c e a b c", "\x0ba\x0bb\x0c"]
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(1000 + i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = quality.base_counts(clash(docs, "n_words", "base_failed")).collect()
    assert len(rows) == docs.count()
    for x in rows:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute(x.text), x.text[:50]


def mcd(x, share, starts, seed):
    """Least covariance determinant over random starts, each concentrated until it settles, then reweighted."""
    g, h, best = np.random.default_rng(seed), int(np.ceil(share * len(x))), (np.inf,)
    distance = lambda m, c: np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(c), x - m)
    for _ in range(starts):
        own = x[g.choice(len(x), x.shape[1] + 2, replace=False)]
        for _ in range(60):
            m, c = own.mean(0), np.cov(own.T, bias=True)
            own = x[np.argsort(distance(m, c), kind="stable")[:h]]
        best = min(best, (np.linalg.det(np.cov(own.T, bias=True)), own.mean(0).tolist(), np.cov(own.T, bias=True).tolist()))
    m, c = np.array(best[1]), np.array(best[2]) * quality.consistency(share, x.shape[1])
    own = x[distance(m, c) <= quality.chi2_quantile(0.975, x.shape[1])]
    return own.mean(0), np.cov(own.T, bias=True) * quality.consistency(0.975, x.shape[1])


def test_chi_square():
    assert abs(quality.chi2_quantile(0.95, 1) - 3.841459) < 1e-5 and abs(quality.chi2_quantile(0.975, 3) - 9.348404) < 1e-5
    assert abs(quality.chi2_below(4.0, 4) - 0.5939942) < 1e-6 and abs(quality.chi2_quantile(1 - 1e-6, 4) - 33.3768) < 1e-3


def test_outliers_against_numpy(spark):
    g = np.random.default_rng(4)
    low = np.array([[1.0, 0, 0], [0.6, 1.2, 0], [-0.4, 0.3, 0.8]])
    groups = {}
    for name, n, off, shift in (("a", 900, 0.1, (15, 15, 0)), ("b", 400, 0.2, (0, -6, 9)), ("c", 120, 0.0, (0, 0, 0))):
        x = g.normal(size=(n, 3)) @ low.T + [1, 2, 3]
        x[: int(off * n)] = x[: int(off * n)] * 0.3 + np.array(shift)
        groups[name] = x
    df = spark.createDataFrame([(k, *map(float, v)) for k, x in groups.items() for v in x] + [("d", 1.0, 1.0, 1.0)] * 60, "unit string, x0 double, x1 double, x2 double")
    found = {r.unit: r for r in quality.robust_outliers(df, 3).collect()}
    for k, x in groups.items():
        m, c = mcd(x, 0.75, 60, 7)
        r = found[k]
        f = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(3)] for i in range(3)])
        got, want = f @ f.T * r.scale, c
        assert r.rank == 3 and np.abs(np.array([r.m0, r.m1, r.m2]) - m).max() < 0.06 and np.abs(got - want).max() < 0.12 * np.abs(want).max(), (k, got, want)
        d = np.einsum("ij,ij->i", (x - [r.m0, r.m1, r.m2]) @ np.linalg.inv(got), x - [r.m0, r.m1, r.m2])
        n_off = {"a": 90, "b": 80, "c": 0}[k]
        assert (d[:n_off] > quality.chi2_quantile(1 - 1e-6, 3)).all() and (d[n_off:] < quality.chi2_quantile(1 - 1e-6, 3)).all()
    assert (found["d"].m0, found["d"].rank) == (1.0, 0)


def test_few_ordinary_texts_are_rejected(spark):
    r, g = random.Random(5), np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(r.choice("abcdefgh") * r.randint(2, 9) for _ in range(int(n))), "en", f"s{i % 3}", 1) for i, n in enumerate(np.exp(g.normal(5.6, 0.6, 900)))], "doc_id long, text string, lang string, source string, n_chars long")
    rows = [x for x in quality.judge_quality(docs).collect() if not x.base_failed]
    assert all(x.distance is not None for x in rows) and sum(not x.kept for x in rows) <= 1


def test_whole_operator(spark):
    r = random.Random(1)
    good = [(i, " ".join(f"w{r.randint(0, 500)}" for _ in range(r.randint(60, 300))), "en", "s0", 1) for i in range(150)]
    bad = [(500, " ".join("#" * 40 + str(i) for i in range(150)), "en", "s0", 1)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string, n_chars long").unionByName(odd_docs(spark))
    rows = quality.judge_quality(docs).collect()
    kept = {x.doc_id for x in rows if x.kept}
    assert len(rows) == docs.count() and 500 not in kept and len(kept & set(range(7, 150))) >= 142
    assert quality.judge_quality(docs.limit(0)).count() == 0
    assert not [x for x in rows if x.base_failed and x.kept]


def test_small_groups_are_judged_by_wider_ones(spark):
    r = random.Random(3)
    word = lambda: r.choice("abcdefgh") * r.randint(2, 9)
    good = [(i, " ".join(word() + r.choice(["", "", "", "#"]) for _ in range(r.randint(80, 200))), ("en", "fr")[i % 2], f"s{i // 20}", 1) for i in range(200)]
    good += [(300 + i, good[i][1], None, None, 1) for i in range(9)]
    bad = [(900 + i, " ".join(f"{k}#" * 60 for k in range(150)), lang, source, 1) for i, (lang, source) in enumerate([("en", "s0"), ("fr", "s9"), (None, None), (None, "s1"), ("xx", "s1")])]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string, n_chars long")
    rows = {x.doc_id: x for x in quality.judge_quality(docs).collect()}  # no (lang, source) group has over 12 rows
    assert len(rows) == len(good + bad) and not [x for x in rows.values() if not x.base_failed and x.distance is None]
    assert not [i for i in rows if i >= 900 and rows[i].kept] and sum(rows[x[0]].kept for x in good) >= 0.98 * len(good)
    few = {x.doc_id: x for x in quality.judge_quality(docs.where("lang = 'en' AND source = 's0'")).collect()}  # nothing wider than 11 rows
    assert len(few) == 11 and not few[900].kept and sum(x.kept for x in few.values()) >= 9
