"""Sessions over time buckets."""

import datetime
import random

from kinloom.operators import health


def test_sessions_over_bucket_edges_equal_one_pass(spark):
    day, rnd = datetime.datetime(2024, 1, 1), random.Random(3)
    minutes = [m for m in range(50, 200, 9)]  # one session over four hours' edges
    minutes += [400, 410, 419.9, 430, 480, 720, 729, 1000]
    rows = [("a", day + datetime.timedelta(minutes=m)) for m in minutes] + [("b", day + datetime.timedelta(seconds=rnd.randrange(400_000))) for _ in range(900)] + [("a", None), (None, day), (None, day)]
    got = sorted(map(tuple, health.sessions(spark.createDataFrame(rows, "source string, created_at timestamp").repartition(5)).collect()), key=repr)
    want = []
    for source in ("a", "b", None):
        times = sorted(int(t.replace(tzinfo=datetime.timezone.utc).timestamp() * 1e6) for s, t in rows if s == source and t)
        for t in times:
            if want and want[-1][1] == source and t - last < 600_000_000:
                want[-1][2] += 1
            else:
                want.append([t, source, 1])
            last = t
    assert got == sorted(map(tuple, want), key=repr) and max(n for _, s, n in got if s == "a") == 17
