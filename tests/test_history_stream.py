"""History of arriving entries equals a plain walk, in whatever batches they come."""

import datetime as dt
import random

import pytest
from pastframe.streaming import history

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "user long, ts timestamp, id long, x double"


def entries(n=400):
    r = random.Random(3)
    rows = [(r.choice([1, 1, 1, 1, 1, 1, 2, 2**60 + 1]), DAY + dt.timedelta(minutes=r.randint(0, 2000)), i, None if r.random() < 0.1 else float(r.randint(0, 99))) for i in range(n)]
    return [*rows, (None, DAY, n, 5.0), (None, DAY + dt.timedelta(days=1), n + 1, 7.0)]


def walk(rows, alpha=1 / 3):
    out, past = {}, {}
    for u, ts, i, _ in rows:
        before = [x for v, t, _, x in sorted(rows, key=lambda z: (z[1], z[2])) if v == u and t < ts]
        mean = lambda s: sum(s) / len(s) if (s := [x for x in s if x is not None]) else None
        ewm = None
        for x in before:
            if x is not None:
                ewm = x if ewm is None else ewm + alpha * (x - ewm)
        out[i] = (mean(before[-10:]), mean(before[-500:]), len(before), ewm)
    return out


def run(own, batches, tmp_path, known=None):
    """Each batch a file, and an entry of the far future that moves the watermark over all of them."""
    for k, b in enumerate([*batches, [(None, DAY + dt.timedelta(days=900), None, None)]]):
        own.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = own.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        got = history.history_before(stream, "user", "x", ["id"], delay="30 days", known=known)
        got.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    return {r.id: (r.last_mean, r.long_term_mean, r.n_before, r.ewm) for r in own.read.parquet(str(tmp_path / "out")).collect()}


@pytest.fixture
def own(spark):
    s = spark.newSession()
    s.conf.set("spark.sql.streaming.stateStore.providerClass", history.STORE)
    s.conf.set("spark.sql.shuffle.partitions", "2")
    s.conf.set("spark.sql.session.timeZone", "UTC")
    return s


def test_batches_in_any_order(own, tmp_path):
    rows = entries()
    mixed = random.Random(4).sample(rows, len(rows))
    got = run(own, [mixed[:150], mixed[150:]], tmp_path)
    want = walk(rows)
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i]) for i in want)


def test_state_of_a_batch_table_is_handed_over(own, tmp_path):
    rows = sorted([r for r in entries() if r[0]], key=lambda r: r[1])
    cut = rows[250][1]
    first, rest = [r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut]
    known = history.state_of(own.createDataFrame(first, SCHEMA), "user", "x", ["id"])
    got = run(own, [rest], tmp_path, known)
    want = walk(rows)
    assert got.keys() == {r[2] for r in rest}
    for i in got:
        assert got[i] == pytest.approx(want[i])
