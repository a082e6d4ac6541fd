"""The exact matching rule with its bounded cache, against a plain simulation."""

import random

import numpy as np
import pandas as pd

from beamframe import streaming


def brute(arrivals, sources, cache):
    held, out = {}, []
    why = lambda have: (lambda missing: f"Not found: {len(missing)} out of {len(sources)}: {missing[0]}")([s for s in sources if s not in have])
    for _, train, source in sorted(arrivals):
        held.setdefault(train, set()).add(source)  # dicts keep the order of insertion
        if len(held[train]) == len(sources):
            older = list(held)[: list(held).index(train)]
            del held[train]
            out += [(train, True, "")] + [(t, False, why(held.pop(t))) for t in older]
        elif len(held) > cache:
            oldest = next(iter(held))
            out.append((oldest, False, why(held.pop(oldest))))
    return sorted(out)


def test_overflow_and_older_trains(spark, tmp_path):
    r = random.Random(3)
    sources, rows = ["a", "b", "c"], []
    for k in range(600):
        rows.append((k, max(0, k // 4 + r.randint(-6, 6)), r.choice(sources)))
    schema = "seq long, train_id long, source string"
    for at in (0, 300):
        spark.createDataFrame(rows[at : at + 300], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{at}"))
    events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    got = []
    out = streaming.correlate_stream_exact(events, sources, 5)
    out.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda b, i: got.extend(tuple(x) for x in b.collect())).start().awaitTermination()
    want = brute(rows, sources, 5)
    assert sorted(got) == want and {x[1] for x in want} == {True, False}


def test_a_micro_batch_is_sorted_in_blocks():
    r = np.random.default_rng(2)
    for n, most in ((0, 10), (9, 10), (5000, 64), (5000, 10**6)):
        rows = np.stack([r.permutation(n), r.integers(-9, 9, n)], axis=1).reshape(-1, 2)
        frames = [pd.DataFrame(rows[i : i + 50], columns=["seq", "t"]) for i in range(0, n, 50)]
        blocks = list(streaming.sorted_blocks(iter(frames), ["seq", "t"], most))
        assert np.array_equal(np.concatenate(blocks), rows[np.argsort(rows[:, 0])])
        assert max(map(len, blocks)) <= 2 * most + 50
