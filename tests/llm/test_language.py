import itertools
import os
import zlib

import numpy as np
import pytest

from beamframe.llm import language as l
from tests.llm.cases import clash, odd_docs

LINES = {
    "en": "the house of the man and that it was with them for they have been there when you said this thing".split(),
    "fr": "la maison de l'homme et que c'était avec eux pour quoi ils étaient là quand vous disiez cette chose".split(),
    "de": "das haus des mannes und dass es mit ihnen war für sie gewesen ist als du diese sache sagtest".split(),
}


def made(spark, n=240):
    r = np.random.default_rng(5)
    rows = []
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, " ".join(r.choice(LINES[lang], 40)), lang, "s", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_marginals_by_enumeration():
    g = np.random.default_rng(1)
    emit, step = g.random((1, 4, 3)) + 0.1, g.random((3, 3)) + 0.1
    want, pair, total = np.zeros((4, 3)), np.zeros((3, 3)), 0
    for path in itertools.product(range(3), repeat=4):
        p = np.prod([emit[0, t, y] for t, y in enumerate(path)]) * np.prod([step[a, b] for a, b in itertools.pairwise(path)])
        total += p
        for t, y in enumerate(path):
            want[t, y] += p
        for a, b in itertools.pairwise(path):
            pair[a, b] += p
    got, pairs = l.marginals(emit, step, np.ones((1, 4)))
    assert np.allclose(got[0], want / total) and np.allclose(pairs, pair / total)
    for block in (1, 2, 3, 64):
        assert np.allclose(l.posterior(emit[0].astype(np.float32), np.arange(4), np.zeros(4, int), step.astype(np.float32), block), want / total, atol=1e-5)


def test_messages_cross_blocks():
    g = np.random.default_rng(2)
    table, step = (g.random((50, 4)) + 0.01).astype(np.float32), (g.random((4, 4)) + 0.01).astype(np.float32)
    text = np.repeat(np.arange(6), [1, 700, 64, 65, 3, 129])
    each = g.integers(0, 50, len(text))
    got = l.posterior(table, each, text, step)
    for d in range(6):
        emit = table[each[text == d]].astype(float)[None]
        want, _ = l.marginals(emit, step.astype(float), np.ones(emit.shape[:2]))
        assert np.allclose(got[text == d], want[0], atol=2e-4)


def test_chains_hold_every_word_once():
    first = np.array([0, 1, 1, 70, 200, 203])
    words, truth = l.chains(first, np.array([0, 1, 2, 1, 0]), np.random.default_rng(1))
    own = words[words >= 0]
    assert sorted(own.tolist()) == list(range(203)) and words.shape[1] == l.CHAIN
    assert (truth[words >= 0] == np.array([0, 1, 2, 1, 0])[np.searchsorted(first, own, "right") - 1]).all()


def test_long_words_are_read_whole():
    raw = ("x" * 25 + " " + "東京都" * 40 + " short " + "é" * 13).encode()
    data, starts, ends, text, letter = l.trimmed_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert (ends - starts).max() <= 24 and letter.all() and b"".join(raw[a:b] for a, b in zip(starts, ends)) == raw.replace(b" ", b"")
    assert all(raw[a:b].decode() for a, b in zip(starts, ends))


def test_scripts_without_spaces_and_short_texts(spark):
    r = np.random.default_rng(3)
    sets = {"zh": "的一是在不了有和人這中大為上個國我以要他", "ja": "あいうえおかきくけこさしすせそたちつてと"}
    rows = [(i, "".join(r.choice(list(sets[lang]), n)), lang) for i in range(160) for lang, n in [(("zh", "ja")[i % 2], (2, 60)[i // 2 % 2])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x.lang_pred for x in l.report(docs).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.95


def test_more_labels_than_are_learned(spark):
    rows = [(i, f"word{i} more text here", f"l{min(i % 40, 9)}") for i in range(800)]
    model = l.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_labels=3)
    assert len(model.labels) == 3 and "l9" in model.labels


def test_held_out_and_code_switched(spark):
    docs = made(spark)
    rows = {x.doc_id: x for x in l.report(docs).collect()}
    truth = {x.doc_id: x.lang for x in docs.collect()}
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= x.score <= 1 for i, x in rows.items())
    own = [i for i in rows if rows[i].held_out]
    assert np.mean([rows[i].lang_pred == truth[i] for i in own]) > 0.95
    model = l.learn(docs)
    text = ("the man said that they have been there 12 " + "das haus des mannes und dass es mit ihnen").encode()
    _, _, (_, _, _, label, _) = l.judge(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    langs = [model.labels[k] for k in label]
    assert langs[:8].count("en") >= 7 and langs[9:].count("de") >= 7


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = l.identify(clash(docs, "score", "lang_pred"), l.learn(made(spark)), ["doc_id"]).collect()
    assert len(rows) == docs.count()
    by = {x.doc_id: x for x in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102))
    assert l.identify(spark.createDataFrame([(1, "東京 都"), (2, "12 34 !!"), (3, "²①"), (4, "µ"), (5, "1 ª"), (6, "º")], "doc_id long, text string"), l.learn(made(spark))).where("lang_pred = 'und'").count() == 2
    assert l.report(docs.limit(0)).count() == 0


def test_prediction_ignores_labels(spark):
    docs = made(spark, 60)
    model = l.learn(docs)
    from pyspark.sql import functions as F

    one = sorted(map(tuple, l.identify(docs, model).collect()))
    two = sorted(map(tuple, l.identify(docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x")), model).collect()))
    assert one == two


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {x.doc_id: x.lang for x in docs.select("doc_id", "lang").collect()}
    rows = [x for x in l.report(docs).collect() if x.held_out]
    assert np.mean([x.lang_pred == truth[x.doc_id] for x in rows]) > 0.9


def test_copies_do_not_fill_or_empty_the_sample(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = made(spark, 90)
    least = docs.where("lang = 'en'").where(~l.held_out(F.col("doc_id"))).orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 30))).first()
    most = docs.where("lang = 'fr'").where(~l.held_out(F.col("doc_id"))).orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 30)).desc()).first()
    copies = spark.range(1000, 9000).select(F.col("id").alias("doc_id"), F.lit(least.text).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    many = copies.withColumns({"text": F.lit(most.text), "lang": F.lit("xx")})  # one text, above any cut by rate
    seen = []
    monkeypatch.setattr(l, "fit", seen.extend)
    l.learn(docs.unionByName(copies).unionByName(many))
    want = {(x.text, x.lang) for x in docs.where(~l.held_out(F.col("doc_id"))).collect()} | {(most.text, "xx")}
    assert len(seen) == len(want) and set(seen) == want
    seen.clear()
    l.learn(docs.unionByName(copies), sample=5)
    assert sorted(y for _, y in seen) == ["de"] * 5 + ["en"] * 5 + ["fr"] * 5 and len(set(seen)) == 15 and set(seen) <= want
    seen.clear()
    l.learn(docs, most_bytes=300)  # about 200 bytes a text: whole texts until 300 bytes are reached
    assert 3 <= len(seen) <= 9 and set(seen) <= want
