"""Streams give what the batch operators give."""

import shutil

from pyspark.sql import functions as F

from lodestone.operators.facts import upserts
from lodestone.operators.sessions import gap_sessions
from lodestone.streaming import streams

DIR = "/root/testdata/sf0.001"


def test_sessions_and_facts(spark, tmp_path):
    for t in ("events", "fact_ops"):
        (tmp_path / t).mkdir()
        shutil.copy(f"{DIR}/{t}.parquet", tmp_path / t)
    ev = spark.read.parquet(f"{tmp_path}/events")
    got: list = []
    live = streams.read_files(spark, f"{tmp_path}/events", ev.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    streams.run(streams.gap_sessions(live, "user_id", "ts", late="1 second"), lambda d, _: got.extend(d.collect()), f"{tmp_path}/c1")
    want = {(r.user_id, r.start_s, r.events) for r in gap_sessions(ev, "user_id", "ts").collect()}
    mine = {(r.user_id, r.start_s, r.events) for r in got}
    assert mine <= want and len(mine) >= 0.9 * len(want)
    seen: list = []
    facts = spark.read.parquet(f"{tmp_path}/fact_ops")
    streams.run(streams.fact_log(streams.read_files(spark, f"{tmp_path}/fact_ops", facts.schema)), lambda d, _: seen.extend(r.seq for r in d.collect()), f"{tmp_path}/c2")
    assert len(seen) == len(set(seen)) > 0


def test_stream_folds_as_the_batch_does(spark, tmp_path):
    (tmp_path / "f").mkdir()
    shutil.copy(f"{DIR}/fact_ops.parquet", tmp_path / "f")
    facts = spark.read.parquet(f"{tmp_path}/f")
    seen: list = []
    live = streams.fact_fold(streams.fact_log(streams.read_files(spark, f"{tmp_path}/f", facts.schema)))
    streams.run(live, lambda d, _: seen.extend((r.seq, r.s, r.p, r.o, r.status, r.version) for r in d.collect()), f"{tmp_path}/c")
    want = {(r.seq, r.s, r.p, r.o, r.status, r.version) for r in upserts(facts).collect()}
    assert want and set(seen) == want and len(seen) == len(want)
