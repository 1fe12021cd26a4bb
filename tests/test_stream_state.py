"""The state of the log's stream: no call for each listing, and a batch that runs again."""

import os
from datetime import datetime, timedelta
from decimal import Decimal

from test_scenarios import HISTORY

from tidemark.operators import events
from tidemark.streaming import ingest


def test_states_meet_a_batch_without_python_and_again(spark, tmp_path):
    """The second batch's commit is lost, so it runs again after its rows and states are written."""
    start = datetime(2026, 6, 1)
    rows = [(n, n % 7, Decimal(n % 5 + 1), n % 3 > 0, start + timedelta(hours=n // 2)) for n in range(60)]
    log = spark.createDataFrame(rows, HISTORY)
    stream = lambda: ingest.log_changes(ingest.arriving(spark, log.schema, f"{tmp_path}/in"))
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], HISTORY).write.mode("append").parquet(f"{tmp_path}/in")
        if k == 0:
            assert "Pandas" not in stream()._jdf.queryExecution().analyzed().toString()
        ingest.run_available(stream(), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        if k == 1:
            for name in ("1", ".1.crc"):
                if os.path.exists(f"{tmp_path}/checkpoint/commits/{name}"):
                    os.remove(f"{tmp_path}/checkpoint/commits/{name}")
            ingest.run_available(stream(), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    want = events.with_previous(log)
    got = ingest.changes_at(spark, f"{tmp_path}/out").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
