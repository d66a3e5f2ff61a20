"""The append state machine: a bucket of files at once, over several triggers, like one file after the other."""

import random

import pandas as pd

from sparkledger.streaming import jobs


class State:
    exists = False

    def update(self, value):
        self.exists, self.get = True, value


def one_by_one(rows, held):
    out = []
    for r in sorted(rows, key=lambda r: r[2]):
        end, fence = held.get(r[:2], (0, 0))
        ok = r[4] >= fence
        end += r[3] if ok else 0
        out.append((*r[:3], ok, "OK" if ok else "FENCED_EPOCH", end))
        held[r[:2]] = (end, max(fence, r[4] + 1) if r[5] else fence)
    return out


def test_files_of_a_bucket_at_once():
    rng, state, held, event = random.Random(5), State(), {}, 0
    for trigger in range(6):
        rows = []
        for _ in range(200):
            event += 1
            rows.append((rng.choice(["a", "b", None]), rng.choice(["1", "2", str(2**53 + 1), None]), event, rng.randrange(9), rng.randrange(5), rng.random() < 0.2))
        rng.shuffle(rows)
        frame = pd.DataFrame(rows, columns=["namespace", "file_id", "event_id", "length", "epoch", "fence"])
        got = pd.concat(jobs.decide((0,), iter([frame[:70], frame[70:]]), state)).astype(object)
        got = [tuple(None if x is None or x != x else x for x in r) for r in got.itertuples(index=False)]
        assert sorted(got, key=lambda r: r[2]) == one_by_one(rows, held)


def test_calls_do_not_follow_the_number_of_files(spark, tmp_path, monkeypatch):
    spark.range(6000).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' AS ts", "id % 3000 AS user_id", "'view' AS event_type", "1.0D AS value", "'abc' AS props").write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    monkeypatch.setattr(jobs, "finish", lambda stream, mode: seen.append(stream._jdf.queryExecution().analyzed().toString()) or spark.createDataFrame([], jobs.DECISIONS))
    jobs.append_machine(spark, str(tmp_path))
    assert "pmod(hash(" in seen[0] and jobs.BUCKETS < 3000
