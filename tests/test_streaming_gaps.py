import datetime as dt
import random

import pytest
from prosewright.operators import usage
from prosewright.streaming.gaps import gaps

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "k string, no long, ts timestamp, v double"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_the_stream_equals_the_batch_across_a_restart_and_drops_silent_keys(rocks, tmp_path):
    spark, rng = rocks, random.Random(3)
    start = dt.datetime(2026, 1, 1)
    minutes = sorted(rng.randrange(40 * 1440) for _ in range(60))
    data = [(f"k{rng.randrange(3)}", i, start + dt.timedelta(minutes=m), 1.0) for i, m in enumerate(minutes)]
    data += [("k0", 100, start, 1.0), ("k0", 101, start, 1.0), ("gone", 102, start, 1.0), ("gone", 103, start + dt.timedelta(days=20), 1.0), (None, 104, start, 1.0)]
    data.sort(key=lambda r: r[2])
    for a in range(0, len(data) - 3, 7):  # late rows within the watermark
        data[a], data[a + 2] = (data[a + 2], data[a]) if data[a + 2][2] - data[a][2] < dt.timedelta(hours=20) else (data[a], data[a + 2])
    end = [("end", 200, start + dt.timedelta(days=90), 1.0), ("end", 201, start + dt.timedelta(days=91), 1.0)]
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"

    def run(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        live = gaps(spark.readStream.schema(SCHEMA).parquet(source), "k", "ts", "no", late="1 day")
        live.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(150)

    half = len(data) // 2
    for part in (data[:half], data[half:], end):  # a restart from the checkpoint before each but the first
        run(part)
    want = [r for r in rows(usage.fresh_gaps(spark.createDataFrame([*data, *end], SCHEMA), "k", "ts", "no")) if r[0] != "end"]
    assert [r for r in rows(spark.read.parquet(sink)) if r[0] != "end"] == want
    assert any(r[6] for r in want) and sum(r[3] is None for r in want if r[0] == "gone") == 2
    kept = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/check").collect()
    assert {r["key"]["k"] for r in kept} <= {"end"}
