import datetime as dt

import pytest
from fixtures import SAMPLE, applications
from pyspark.sql import functions as F

from credilake.constants import KEY
from credilake.functions import decisions, scoring
from credilake.operators.validate import RULES
from credilake.plans.catalog_core import decided, fixed_probability
from credilake.sources import evaluations as log
from credilake.streaming import jobs


@pytest.fixture(scope="module")
def rows(profile):
    at = F.to_timestamp(F.lit("2024-03-05 08:00:00")) + F.make_interval(days=(F.col(KEY) % 3).cast("int"))
    return log.evaluation_rows(decided(profile), at)


def test_append_is_partitioned_by_day(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    log.append_evaluations(rows, path)
    log.append_evaluations(rows.limit(5), path)
    back = log.read_evaluations(spark, path)
    assert back.count() == rows.count() + 5
    assert {r[0].isoformat() for r in back.select("created_date").distinct().collect()} == {
        "2024-03-05", "2024-03-06", "2024-03-07",
    }
    plan = back.where(F.col("created_date") == dt.date(2024, 3, 6))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan
    row = rows.first()
    assert row.confidence_frac == pytest.approx(max(row.probability, 1 - row.probability)) and row.true_label is None


def test_labels_and_deletions(spark, rows, tmp_path):
    ids = [r.id for r in rows.orderBy("id").limit(3).collect()]
    labels = spark.createDataFrame(
        [(ids[0], 0, dt.datetime(2024, 4, 1), 1), (ids[0], 1, dt.datetime(2024, 4, 2), 2), (ids[1], 7, dt.datetime(2024, 4, 2), 3)],
        "id long, true_label int, updated_at timestamp, event_id long",
    )
    log.set_true_label(labels, str(tmp_path / "labels"))
    log.delete_evaluations(spark.createDataFrame([(ids[2],)], "id long"), str(tmp_path / "deleted"))
    live = log.live_evaluations(rows, spark.read.parquet(str(tmp_path / "labels")), spark.read.parquet(str(tmp_path / "deleted")))
    assert live.count() == rows.count() - 1
    assert {r.id: r.true_label for r in live.where("true_label is not null").collect()} == {ids[0]: 1}
    counts = log.evaluation_counts(live).first()
    assert (counts.total, counts.labelled) == (rows.count() - 1, 1)
    log.compact(live, str(tmp_path / "compacted"))
    assert log.read_evaluations(spark, str(tmp_path / "compacted")).where("true_label = 1").count() == 1


def _files(root):
    return {p: p.stat().st_mtime_ns for p in root.rglob("*.parquet") if "data" in p.parts}


def test_compaction_rewrites_touched_days_only(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    assert log.read_snapshot(spark, path).count() == 0
    first = log.append_snapshot(rows, path)
    by_day = {r.day: r.ids for r in rows.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()}
    one, gone = by_day["2024-03-05"][0], by_day["2024-03-05"][1]
    labels = spark.createDataFrame([(one, 1, dt.datetime(2024, 4, 2), 2)], "id long, true_label int, updated_at timestamp, event_id long")
    deleted = spark.createDataFrame([(gone,), (gone,), (-1,)], "id long")
    reader = log.read_snapshot(spark, path)  # opened before, read after
    before = _files(tmp_path / "log")
    assert log.compact_touched(spark, path, labels, deleted) == ["2024-03-05"]
    after = _files(tmp_path / "log")
    assert {p: t for p, t in after.items() if p in before} == before
    assert {p.parent.name for p in after if p not in before} == {"created_date=2024-03-05"}
    assert reader.count() == log.read_snapshot(spark, path, first).count() == rows.count()
    expected = log.live_evaluations(rows, labels, deleted)
    now = log.read_snapshot(spark, path)
    assert now.drop("created_date").exceptAll(expected).count() == 0 and now.count() == rows.count() - 1
    assert log.compact_touched(spark, path, labels, deleted) == []
    # a day of two segments is joined into one; repeated ids stay
    log.append_snapshot(rows.where(F.col("created_at") < "2024-03-06").limit(3), path)
    assert log.compact_touched(spark, path) == ["2024-03-05"]
    assert log.read_snapshot(spark, path).count() == rows.count() + 2


def test_a_lost_compaction_and_a_day_that_empties(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    log.append_snapshot(rows, path)
    deleted = rows.where(F.col("created_at") < "2024-03-06").select("id")
    with monkeypatch.context() as m:
        m.setattr(log.snapshots, "publish", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            log.compact_touched(spark, path, None, deleted)
    assert log.read_snapshot(spark, path).count() == rows.count()
    assert log.compact_touched(spark, path, None, deleted) == ["2024-03-05"]
    days = {r.created_date.day for r in log.read_snapshot(spark, path).select("created_date").distinct().collect()}
    assert days == {6, 7}
    with pytest.raises(FileNotFoundError):
        log.read_snapshot(spark, path, 9)


def test_rows_without_a_date(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    log.append_snapshot(rows.limit(4).withColumn("created_at", F.lit(None).cast("timestamp")), path)
    stored = log.read_snapshot(spark, path)
    assert stored.count() == 4 and stored.where("created_date is null").count() == 4
    assert log.compact_touched(spark, path, None, stored.select("id").limit(1)) == [log._NO_DAY]
    assert log.read_snapshot(spark, path).count() == 3


def test_recent_is_a_top_k(rows):
    recent = log.recent_evaluations(rows, 10)
    assert recent.count() == 10 and "TakeOrderedAndProject" in recent._jdf.queryExecution().executedPlan().toString()
    assert {r.created_at.day for r in recent.collect()} == {7}


def test_stream_equals_batch(spark, profile, tmp_path):
    bad = applications(spark, SAMPLE | {"ingreso_mensual": 0})
    stamped = profile.drop("viable").na.fill(0).unionByName(bad).withColumn("created_at", F.to_timestamp(F.lit("2024-01-01 10:00:00")))
    stamped.write.json(str(tmp_path / "in"))
    predict = lambda df: decisions.prediction(fixed_probability(df))
    stream = jobs.score_stream(jobs.read_applications(spark, str(tmp_path / "in"), 1), predict)
    jobs.write_evaluations(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    valid = stamped.where("ingreso_mensual > 0")
    batch = decisions.recommend(scoring.adjust_with_probability(scoring.score(predict(valid))))
    columns = ["probability", "total_score", "classification", "final_decision"]
    stored = log.read_evaluations(spark, str(tmp_path / "out"))
    key = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert key(stored) == key(batch) and stored.count() == profile.count()


def test_late_rows_are_dropped(spark, tmp_path):
    source = tmp_path / "in"

    def arrive(name, *stamps):
        source.mkdir(exist_ok=True)
        lines = "".join(f'{{"final_decision": "A", "created_at": "{s}"}}\n' for s in stamps)
        (source / name).write_text(lines)

    def run():
        stream = spark.readStream.schema("final_decision string, created_at timestamp").json(str(source))
        counts = jobs.decision_counts_stream(stream, "1 day", "1 hour")
        jobs.write_windows(counts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()

    arrive("a.json", "2024-01-01 01:00:00", "2024-01-01 02:00:00", "2024-01-03 12:00:00")
    run()
    arrive("b.json", "2024-01-01 03:00:00", "2024-01-05 12:00:00")  # the first is far beyond the watermark
    run()
    got = {r.window_start.date().isoformat(): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2024-01-01": 2, "2024-01-03": 1}


def test_label_events_are_taken_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{{"id": {}, "true_label": {}, "updated_at": "2024-01-0{}T00:00:00", "event_id": {}}}\n'
    (tmp_path / "in" / "a.json").write_text(line.format(1, 0, 1, 1) * 2 + line.format(1, 1, 2, 2) + line.format(2, 5, 2, 3))
    stream = jobs.label_stream(jobs.read_labels(spark, str(tmp_path / "in")))
    jobs.write_labels(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == 2  # a repeated delivery is logged once, 5 is no label
    assert {r.id: r.true_label for r in log.latest_labels(stored).collect()} == {1: 1}


def test_labels_older_than_any_watermark_are_kept(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{{"id": {}, "true_label": {}, "updated_at": "2024-0{}-01T00:00:00", "event_id": {}}}\n'
    for name, row in (("a", (1, 0, 6, 1)), ("b", (2, 1, 1, 2)), ("c", (1, 1, 2, 3))):
        (tmp_path / "in" / f"{name}.json").write_text(line.format(*row))
        stream = jobs.label_stream(jobs.read_labels(spark, str(tmp_path / "in"), 1))
        jobs.write_labels(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert {r.id: r.true_label for r in log.latest_labels(stored).collect()} == {1: 0, 2: 1}


def _labels(folder, name, *rows):
    """A file of label events (id, label, month, event)."""
    folder.mkdir(exist_ok=True)
    line = '{{"id": {}, "true_label": {}, "updated_at": "2024-{:02d}-01T00:00:00", "event_id": {}}}\n'
    (folder / name).write_text("".join(line.format(*r) for r in rows))


def test_repeats_are_known_over_runs(spark, tmp_path):
    events = [(1, 0, 6, 1), (1, 1, 2, 2), (2, 1, 3, 3)]
    for name in ("a.json", "b.json"):
        _labels(tmp_path / "in", name, *events, events[0])
        stream = jobs.label_stream(jobs.read_labels(spark, str(tmp_path / "in"), 1))
        jobs.write_labels(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id, r.event_id) for r in stored.collect()) == [(1, 1), (1, 2), (2, 3)]


def test_newest_label_holds_against_repeats_and_stragglers(spark, tmp_path):
    def run():
        stream = jobs.newest_labels_stream(jobs.read_labels(spark, str(tmp_path / "in"), 1))
        jobs.write_newest_labels(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r.batch, r.id, r.event_id, r.true_label) for r in rows)

    _labels(tmp_path / "in", "a.json", (1, 0, 6, 1), (1, 1, 7, 2), (2, 1, 3, 3), (3, 9, 9, 9))
    assert run() == [(0, 1, 2, 1), (0, 2, 3, 1)]
    _labels(tmp_path / "in", "b.json", (1, 1, 7, 2), (1, 0, 1, 4), (2, 0, 4, 5))  # a repeat, a straggler, a newer one
    assert run() == [(0, 1, 2, 1), (0, 2, 3, 1), (1, 1, 2, 1), (1, 2, 5, 0)]


def test_every_application_is_logged_or_rejected(spark, profile, tmp_path, monkeypatch):
    good = profile.drop("viable").na.fill(0).limit(40)
    bad = applications(spark, SAMPLE | {"ingreso_mensual": 0}, SAMPLE | {"tem": 2, "num_cuotas": 0})
    stamped = good.unionByName(bad).withColumn("created_at", F.to_timestamp(F.lit("2024-01-01 10:00:00")))
    stamped.repartition(3).write.json(str(tmp_path / "in"))
    (tmp_path / "in" / "torn.json").write_text('{"id_cliente": 7, "ingr\n')
    paths = [str(tmp_path / n) for n in ("out", "errors", "cp")]

    def run():
        stream = jobs.read_applications(spark, str(tmp_path / "in"), 1)
        jobs.write_scored(stream, lambda df: decisions.prediction(fixed_probability(df)), *paths).awaitTermination()

    replace = jobs._replace_batch

    def failing(rows, path, *partitions):
        if path == paths[1]:
            raise RuntimeError("lost between the two tables")
        replace(rows, path, *partitions)

    monkeypatch.setattr(jobs, "_replace_batch", failing)
    with pytest.raises(Exception, match="lost between"):
        run()  # the first batch is in the log and not in the error table
    monkeypatch.setattr(jobs, "_replace_batch", replace)
    run()
    logged, errors = log.read_evaluations(spark, paths[0]), spark.read.parquet(paths[1])
    assert logged.count() == 40 and errors.count() == 3
    assert sorted(len(r.reject_reasons) for r in errors.collect()) == [1, 2, len(RULES)]
    run()
    assert log.read_evaluations(spark, paths[0]).count() == 40
