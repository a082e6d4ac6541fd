"""Line dedup against a plain version that counts every line."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from beamframe.llm import lines
from tests.llm.cases import clash, odd_docs, same

BLANK = " \t\n\x0b\x0c\r"
UPPER = str.maketrans(lines.UPPER, lines.LOWER)


def plain(rows, least, enough):
    """rows: (doc_id, text)."""
    key = lambda line: line.strip(BLANK).translate(UPPER)
    order = lambda i: (i is not None, i)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    last = {k: max(h, key=order) for k, h in holders.items() if len(h) >= enough}
    out = []
    for i, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if key(x) not in last or last[key(x)] == i]
        out.append((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def corpus(seed, n):
    r = random.Random(seed)
    pool = [("Line %d of the Pool, ÄÖ " % k) * 2 for k in range(12)] + ["short", "", " \t", "x" * 40, "x" * 39, "É" * 40, "é" * 40]
    dress = [lambda x: x, lambda x: x.upper() if x.isascii() else x, lambda x: "\t " + x + "\r", lambda x: x + "\x0b\x0c", lambda x: "\x85" + x]
    rows = [(i, "\n".join(r.choice(dress)(r.choice(pool[:4] if r.random() < 0.5 else pool)) for _ in range(r.randrange(12)))) for i in range(n)]
    rows += [(None, pool[0] + "\nown"), (None, pool[0]), (None, None), (n, None), (n + 1, ""), (n + 2, "\n"), (n + 3, "\n".join([pool[1]] * 3000 + ["tail"])), rows[0], (rows[1][0], rows[2][1])]
    return rows


@pytest.mark.parametrize(("n", "batches"), [(4, 1), (30, 4), (120, 9)])
def test_lines_that_many_documents_hold_stay_in_the_last_one(spark, n, batches):
    rows = corpus(n, n)
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"), "pos", "batch", "h1", "last").repartition(3)
    got = lines.report(df, least=20, enough=5, batches=batches)
    same([tuple(r) for r in got.collect()], plain(rows, 20, 5))


def test_odd_documents_and_other_columns(spark):
    docs = odd_docs(spark).withColumn("n_lines", F.lit("old"))
    got = lines.drop_common_lines(docs, least=5, enough=2)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped", "kept"]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = [(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got.collect()]
    same(out, plain(rows, 5, 2))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.report(empty).collect() == []


def test_runs_are_compacted_and_settled_hashes_add_nothing(spark):
    runs = lines.LineRuns(spark, 4, 3)
    for first in range(90, -10, -10):  # ten batches of ten documents, the largest ids first; hash 1 is in all, hash 2 in few
        batch = spark.range(first, first + 10).selectExpr("id AS doc_id", "1L AS h1", "1L AS h2").union(spark.range(first, first + 1).selectExpr("id", "2L", "id % 20"))
        runs.add(batch.union(batch))
    assert [len(level) for level in runs.levels] == [0, 1, 0, 1]
    held = [tuple(r) for level in runs.levels for name in level for r in spark.table(name).collect()]
    assert [h for h in held if h[0] == 1] == [(1, 1, 10, 99)]  # written by the first batch alone
    assert sorted(map(tuple, runs.frequent().collect())) == [(1, 1, 99), (2, 0, 80), (2, 10, 90)]
    plan = runs._merged([name for level in runs.levels for name in level])
    assert sorted(map(tuple, plan.where("h1 = 1").collect())) == [(1, 1, 10, 99)]
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runs.close()


def test_no_python_runs(spark, sf_dir):
    df = lines.drop_common_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
