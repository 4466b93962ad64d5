"""T8 keyed state: sessions share buckets, so the number of calls doesn't grow with the sessions."""
import random
from collections import defaultdict
from datetime import datetime, timedelta

from quarry.streaming import jobs as sj

DAY = datetime(2024, 1, 1)
SCHEMA = "session_id long, feedback_id long, ts timestamp, mtype string, rating double"


def batch_rule(rows, until):
    """(session, feedback, start, count) of all rows up to `until` minutes."""
    by = defaultdict(list)
    for s, i, m, *_ in rows:
        by[s].append((m, i))
    out = set()
    for s, xs in by.items():
        last = start = count = None
        for m, i in sorted(xs):
            if last is None or m - last >= 240:
                start, count = m, 0
            last, count = m, count + 1
            if m <= until:
                out.add((s, i, DAY + timedelta(minutes=start), count))
    return out


def test_buckets_hold_few_state_rows_and_give_the_batch_rule(spark, tmp_path):
    rng = random.Random(5)
    rows = [(s, 1000 * k + n, rng.randrange(0, 3 * 24 * 60), rng.choice(["positive", "negative", "correction"]), rng.choice([None, 1.0, 5.0]))
            for k, s in enumerate([None, 0, -1, 2**60 + 1, *range(1, 200)]) for n in range(rng.randrange(1, 15))]
    src, root = str(tmp_path / "src"), str(tmp_path)
    rows.sort(key=lambda r: r[2])
    cut = len(rows) // 2
    for part in (rows[:cut], rows[cut:]):
        x = [(s, i, DAY + timedelta(minutes=m), k, r) for s, i, m, k, r in part]
        spark.createDataFrame(x, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        out = sj.stream_session_phase(sj.file_stream(spark, src, "*.parquet"), buckets=4)
        q = sj.run_available_now(out, f"{root}/out", f"{root}/ckpt")
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 5
    got = spark.read.schema(out.schema).parquet(f"{root}/out").collect()
    want = batch_rule(rows, rows[-1][2] - 60)
    assert len(got) == len(want) and {(r.session_id, r.feedback_id, r.session_start, r.feedback_count) for r in got} == want
