"""Streams: late rows, repeats, restarts, and equality with batch."""

from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerlens.operators.baseline import with_baseline
from ledgerlens.sources.evolving import scratch_folder
from ledgerlens.sources.tables import message_stream
from ledgerlens.streaming import jobs
from ledgerlens.streaming.baseline import _processor, baseline_stream

T0 = datetime(2024, 1, 1)
SCHEMA = "txn_id long, user_id long, ts timestamp_ntz, amount double"


def frame(spark, *rows):
    return spark.createDataFrame([(i, 1, T0 + timedelta(days=d), a) for i, d, a in rows], SCHEMA)


def source(spark, folder, part):
    part.write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(part.schema).parquet(f"{folder}/in")


def test_dedup_across_restarts(spark):
    folder = scratch_folder(spark, "dedup")
    parts = [frame(spark, (1, 0, 5.0), (2, 0, 5.0), (1, 0, 5.0)), frame(spark, (2, 0.2, 9.0), (3, 0.3, 1.0))]
    out = jobs.feed(parts, folder, jobs.dedup_stream)
    assert sorted(r.txn_id for r in out.collect()) == [1, 2, 3]


def test_late_rows_are_dropped_and_counted(spark):
    folder = scratch_folder(spark, "weekly")
    late = 0
    for part in [frame(spark, (1, 0, 5.0), (2, 1, 5.0)), frame(spark, (3, 20, 1.0)), frame(spark, (4, 2, 100.0), (5, 40, 1.0))]:
        stream = jobs.weekly_stream(source(spark, folder, part))
        late += jobs.late_rows(jobs.run_available(stream, folder))
    got = jobs.read_out(stream, folder).collect()
    assert late == 1
    assert sorted((r.week_start, r.total) for r in got) == [(datetime(2023, 12, 28), 10.0), (datetime(2024, 1, 18), 1.0)]


def test_baseline_equals_batch(spark, views):
    rows = views.event_txn.select("txn_id", "user_id", "ts", "amount", "hour_of_day")
    folder = scratch_folder(spark, "baseline")
    days = [rows.filter(F.dayofmonth("ts") <= 12), rows.filter(F.dayofmonth("ts") > 12)]
    build = lambda s: baseline_stream(s, days=10)
    streamed = jobs.feed(days, folder, build)
    batch = with_baseline(rows, days=10)
    cols = ["n", "mean", "std", "mean_hour", "std_hour", "z_amount", "z_hour"]
    both = streamed.join(batch.select("txn_id", *[F.col(c).alias(f"b_{c}") for c in cols]), "txn_id")
    assert streamed.count() == both.count() == rows.count()
    for c in cols:
        assert both.filter(F.abs(F.col(c) - F.col(f"b_{c}")) > 1e-8).count() == 0
    assert both.filter("n >= 5").count() > 0


def test_late_rows_enter_the_baseline_only(spark):
    folder = scratch_folder(spark, "late")
    hours = lambda df: df.withColumn("hour_of_day", F.hour("ts"))
    parts = [hours(frame(spark, (1, 5, 5.0))), hours(frame(spark, (2, 3, 7.0))), hours(frame(spark, (3, 6, 1.0)))]
    got = {r.txn_id: r.n for r in jobs.feed(parts, folder, baseline_stream).collect()}
    assert got == {1: 0, 2: 0, 3: 2}


def test_rows_without_time(spark):
    rows = spark.createDataFrame([(1, 1, None, 5.0), (2, 1, T0, 5.0)], SCHEMA).withColumn("hour_of_day", F.hour("ts"))
    out = jobs.feed([rows], scratch_folder(spark, "untimed"), baseline_stream)
    assert {r.txn_id: r.n for r in out.collect()} == {1: 0, 2: 0}


def test_replayed_batch_adds_nothing(spark):
    folder = scratch_folder(spark, "replay")
    written = []

    def twice(batch, number):
        for _ in range(2):
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        written.append(number)

    stream = source(spark, folder, frame(spark, (1, 0, 5.0), (2, 0, 6.0)))
    jobs.run_available(stream, folder, each_batch=twice)
    assert written == [0] and jobs.read_out(stream, folder).count() == 2


def test_messages(spark, views):
    folder = scratch_folder(spark, "messages")
    views.sms.select("msg_id", "user_id", "ts", "sender", "body").write.parquet(f"{folder}/messages")
    stream = jobs.sms_stream(message_stream(spark, folder, files_per_trigger=1))
    jobs.run_available(stream, folder)
    got = jobs.read_out(stream, folder)
    assert got.filter("reason is null").count() > 0 and got.filter("reason is not null").count() > 0


class FakeState(dict):
    """A value and a map state in one, in memory."""

    getValueState = getMapState = lambda self, name, *_: self.setdefault(name, FakeState())
    exists = lambda self: "value" in self
    get = lambda self: self["value"]
    getValue = dict.get
    update = lambda self, value: self.__setitem__("value", value)
    updateValue = dict.__setitem__
    removeKey = dict.pop


def test_baseline_state_takes_and_gives_rows():
    """A user's rows go in and out as they are: no frame a user and trigger."""
    names = ["txn_id", "note"]
    outputs = ["__n", "__x", "__xx", "__hn", "__h", "__hh", "__centre"]
    processor = _processor(names, outputs, 10 * 100, 100)
    processor.init(FakeState())
    Given = Row(*names, "row_at", "row_amount", "row_hour")
    first = [Given(2, "b", 250, 6.0, None), Given(1, None, 240, 4.0, 3), Given(3, "c", None, 9.0, 1)]
    out = list(processor.handleInputRows((7,), iter(first), None))
    assert out[0] == Row(*names, *outputs)(3, "c", *[0.0] * 7)
    assert [(r.txn_id, r.note, r["__n"], r["__x"], r["__hn"], r["__h"], r["__centre"]) for r in out[1:]] == [
        (1, None, 0.0, 0.0, 0.0, 0.0, 5.0), (2, "b", 1.0, -1.0, 1.0, 3.0, 5.0)]
    (late,) = processor.handleInputRows((7,), iter([Given(4, "d", 1245, 1.0, 2)]), None)
    assert (late["__n"], late["__x"], late["__hn"]) == (1.0, 1.0, 0.0)  # the row at 240 has left the window


def test_rows_without_a_user_leave_the_others_alone(spark):
    """A null user is a user of its own, as in batch; with a null in a batch no key is mistaken for another."""
    schema = "txn_id long, user_id long, ts timestamp_ntz, amount double, hour_of_day int"
    rows = spark.createDataFrame(
        [(i, None if i % 4 == 0 else i % 7, T0 + timedelta(hours=7 * i), float(i % 11), i % 24) for i in range(160)], schema)
    folder = scratch_folder(spark, "nobody")
    streamed = jobs.feed([rows.filter("txn_id < 90"), rows.filter("txn_id >= 90")], folder, lambda s: baseline_stream(s, days=10))
    got = {r.txn_id: (r.n, round(r.z_amount, 6)) for r in streamed.collect()}
    assert got == {r.txn_id: (r.n, round(r.z_amount, 6)) for r in with_baseline(rows, days=10).collect()}
