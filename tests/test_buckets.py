"""Streams whose state is kept in buckets of many keys, against loops over the rows."""

import random

from beamframe.streaming import states
from tests.test_states import SCHEMA, Feed, at


def test_many_trains_share_a_bucket(spark):
    r = random.Random(4)
    rows = [(1000 + k % 300, r.choice("abc"), at(k / 1500), k, None if k % 50 == 7 else r.random()) for k in range(1500)]
    feed = Feed(spark, SCHEMA, lambda e: states.match_trains(e, ["a", "b", "c"], 10 * 60_000, "1 minute", buckets=2))
    parts, held, gone, want = [rows[:700], rows[700:]], {}, set(), []
    for part in parts:
        for t, s, ts, seq, v in part:
            if t not in gone and (s not in held.setdefault(t, {}) or (ts, seq) > held[t][s][:2]):
                held[t][s] = (ts, seq, v)
        for t in [t for t, h in held.items() if len(h) == 3]:
            gone.add(t)
            want.append((t, True, "", *[held[t][s][2] for s in "abc"]))
            del held[t]
    got = feed(parts[0]) + feed(parts[1])
    assert sorted(got, key=str) == sorted(want, key=str) and 0 < len(held) < 300
    why = lambda h: (lambda m: f"Not found: {len(m)} out of 3: {m[0]}")([s for s in "abc" if s not in h])
    over = [(t, False, why(h), *[h[s][2] if s in h else None for s in "abc"]) for t, h in held.items()]
    got = feed([(9, "a", at(60), 9999, 1.0)])
    assert sorted(got, key=str) == sorted(over, key=str)


def test_many_rings_share_a_bucket(spark):
    r = random.Random(6)
    rows = [(r.choice([None, 2**60 + 1, 2**60 + 2, *range(40)]), k * 7919 % 1009, None if k % 40 == 3 else float(k)) for k in range(900)]
    feed = Feed(spark, "k long, at long, v double", lambda e: states.last_n_stream(e, "k", "at", "v", 4, buckets=3))
    changes = feed(rows[:500]) + feed(rows[500:])
    left = states.history_of(spark.createDataFrame(changes, "k long, at long, v double, change long")).collect()
    want = [(k, *p) for k in {x[0] for x in rows} for p in sorted((x[1:] for x in rows if x[0] == k), key=lambda p: -p[0])[:4]]
    assert sorted(map(tuple, left), key=str) == sorted(want, key=str)
