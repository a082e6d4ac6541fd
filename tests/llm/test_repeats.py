import collections
import hashlib
import random
import tempfile
import tracemalloc

import numpy as np

from beamframe.llm import repeats
from beamframe.llm import textbatch as tb
from tests.llm.cases import clash, odd_docs


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        rest = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(rest).hexdigest()))
    return out


def corpus(length):
    r = random.Random(6)
    letters = "abcdé fgh\n"
    rand = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [rand(r.choice([length // 2, length - 1, length, length + 1, 2 * length, 4 * length])) for _ in range(25)]
    texts = []
    for _ in range(160):
        own = ""
        for _ in range(r.randint(1, 4)):
            own += rand(r.randint(0, length)) + (r.choice(passages) if r.random() < 0.6 else "")
        if r.random() < 0.2 and own:
            k = r.randrange(len(own))
            own = own[:k] + "X" + own[k:]
        texts.append(own)
    texts += texts[:12] + texts[:12] + ["a" * (3 * length), "ab" * length, "a" * length, "z" * length, "", None, "q" * (length - 1), rand(30) + passages[4] + rand(5) + passages[4]]
    base = rand(3 * length)
    for i in range(40):  # copies with an edit each
        k = r.randrange(len(base))
        texts.append(base[:k] + str(i) + base[k + 1 :])
    return texts


def check(spark, texts, length, parts=3):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = repeats.remove_repeats(clash(docs, "row", "path", "h").repartition(parts), length).collect()
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows}
    want = dict(enumerate(brute(texts, length)))
    assert len(rows) == len(texts)
    assert got == want, [(i, got[i], want[i]) for i in want if got[i] != want[i]][:4]


def test_by_brute_force(spark):
    check(spark, corpus(40), 40)


def test_frequent_anchors_and_shuffled_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 3)
    monkeypatch.setattr(repeats, "MOST_BROADCAST", 0)
    check(spark, corpus(24), 24)


def test_plain_table_and_odd_rows(spark):
    docs = odd_docs(spark)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    docs.write.parquet(path)
    rows = repeats.remove_repeats(spark.read.parquet(path), 200, with_kept=True).collect()
    texts = [x.text for x in docs.collect()]
    assert sorted((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows) == sorted(brute(texts, 200))
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in rows)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_working_memory_is_bounded():
    """Arrays of a run of texts, about 80 bytes for each of its bytes: under 32 MB, also for many megabytes of text."""
    r = random.Random(4)
    texts = ["".join(r.choices("abcdefgh ", k=4000)) for _ in range(600)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.arange(0, len(data) + 1, 4000)
    tb.powers(tb.RUN_BYTES)
    tracemalloc.start()
    for first, last in tb.runs(offsets):
        repeats.segments(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32e6


def test_anchors_cut_by_batches_and_by_windows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "WINDOWS", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        check(spark, corpus(32), 32)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_python_worker_a_task(spark, sf_dir):
    """Rows are numbered by a join, so no stage runs a second Python function before the one that works on texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "MapInArrow" not in repeats._rows(docs)._jdf.queryExecution().executedPlan().toString()
