"""Stateful pairing of turns equals the batch form in any order of arrival."""

import datetime as dt
import random
from collections import Counter

import pytest

from kbforge.operators.chatlog import pair_turns
from kbforge.streaming import pairing

SCHEMA = "conv_id long, turn long, role string, text string, logged_at timestamp"
START = dt.datetime(2024, 1, 1)


def plain(turns):
    out = []
    for i, (n, role, text) in enumerate(turns):
        if role == "user":
            nxt = turns[i + 1] if i + 1 < len(turns) else (None, None, None)
            out.append((n, text, nxt[2] if nxt[1] == "assistant" else None, nxt[1] == "assistant" and nxt[2] is not None))
    return Counter(out)


@pytest.mark.parametrize("seed", range(8))
def test_any_order_settles_the_same_pairs(seed):
    rng = random.Random(seed)
    numbers = sorted(rng.sample(range(60), 30))
    turns = [(n, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{n}", None, ""])) for n in numbers]
    shuffled = turns + rng.sample(turns, 5)
    rng.shuffle(shuffled)
    runs, got = [], []
    for t in shuffled:
        got += pairing.insert(runs, *t)
        assert runs == sorted(runs) and all(a[pairing.HI] + 1 < b[pairing.LO] for a, b in zip(runs, runs[1:]))
    assert len(runs) < len(turns)
    assert Counter(got + pairing.close(runs)) == plain(turns)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for c in range(12):
        n = 0
        for _ in range(rng.randint(1, 15)):
            n += rng.choice([1, 1, 1, 2])
            rows.append((c, n, rng.choice(["user", "user", "assistant", "system"]), f"{c}-{n}", START + dt.timedelta(seconds=rng.randint(0, 600))))
    want = pair_turns(spark.createDataFrame(rows, SCHEMA)).collect()
    rng.shuffle(rows)
    parts = [rows[k::4] for k in range(4)]
    # Two late turns of another conversation let the others time out.
    parts += [[(99, k, "system", "", START + dt.timedelta(days=k))] for k in (1, 2)]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"k{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out, at = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    query = pairing.pair_turns_stream(stream, "1 hour").writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out)
    query.awaitTermination()
    got = spark.read.parquet(out).where("conv_id <> 99").select("conv_id", "turn", "query", "answer", "answered").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))
