"""Audit log, what-if, streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from holdfast import schema as S
from holdfast.catalog import load
from holdfast.operators import audit, scoring, segments
from holdfast.operators.scorecard import DEFAULT_CARD
from holdfast.plans.scored import featured_accounts
from holdfast.sources.accounts import accounts
from holdfast.streaming import jobs


def _at():
    return F.timestamp_seconds(F.unix_date("signup_date").cast("bigint") * 86400 + F.col(S.KEY) % 86400)


def test_audit_append_and_query(spark, sf_dir, tmp_path):
    scored = scoring.score_records(accounts(spark, sf_dir), DEFAULT_CARD.score)
    rows = audit.audit_rows(scored, _at(), ["account_id", "tenure"])
    path = str(tmp_path / "log")
    audit.append_audit(rows.where("risk_tier = 'High'"), path, "a")
    audit.append_audit(rows.where("risk_tier <> 'High'"), path, "b")
    audit.append_audit(rows.where("risk_tier <> 'High'"), path, "b")  # a retry
    audit.append_audit(rows, path, "c")  # nothing new
    log = audit.read_audit(spark, path)
    assert log.count() == rows.count()
    newest = audit.recent(log, 5, risk_tier="High", churn_only=True).collect()
    assert len(newest) == 5
    assert all(r.risk_tier == "High" and r.churn_result for r in newest)
    assert [r.timestamp for r in newest] == sorted((r.timestamp for r in newest), reverse=True)
    assert audit.audit_stats(log).first().total_predictions == rows.count()
    empty = audit.audit_stats(log.where("false")).first()
    assert (empty.total_predictions, empty.average_probability, empty.tier_breakdown) == (0, 0.0, "")


def test_empty_batch_summary(spark, sf_dir):
    from holdfast.plans.scored import scored_accounts

    row = segments.batch_summary(scored_accounts(spark, sf_dir).where("false")).first()
    assert (row.total, row.churners, row.churn_rate_pct, row.total_clv_at_risk) == (0, 0, None, 0.0)


def test_what_if_modes(spark, sf_dir):
    raw = accounts(spark, sf_dir).where("TechSupport = 'No'").orderBy("account_id").limit(20).persist()
    charges = {r.account_id: r.MonthlyCharges for r in raw.collect()}
    cases = {"same": {}, "cheap": {"MonthlyCharges": 20.0}, "support": {"TechSupport": "Yes", "no_such": 1}}
    rebuilt = {(r.account_id, r.scenario): r for r in scoring.what_if(raw, cases, DEFAULT_CARD.score).collect()}
    frozen = {
        (r.account_id, r.scenario): r
        for r in scoring.what_if(
            scoring.serving_features(raw, "keep"), cases, DEFAULT_CARD.score, mode="frozen_features"
        ).collect()
    }
    assert len(rebuilt) == len(frozen) == 60
    for (account, case), r in rebuilt.items():
        f = frozen[account, case]
        if case == "same":
            assert r.delta.probability_change == 0 and r.delta.clv_change == 0
        if case == "support":
            # One more service lowers the rebuilt score; frozen features cannot notice it.
            assert r.delta.probability_change < 0
            assert f.delta.probability_change == 0
        if case == "cheap":
            assert r.simulated.probability == pytest.approx(f.simulated.probability)
            # At the original charge the value moves with the score alone: up exactly when the
            # simulated charge is the lower one (an account at the horizon has no value to move).
            lower = f.delta.probability_change < 0
            assert lower == (charges[account] > 20.0)
            assert f.delta.clv_change >= 0 if lower else f.delta.clv_change <= 0
    with pytest.raises(ValueError, match="mode"):
        scoring.what_if(raw, cases, DEFAULT_CARD.score, mode="other")


def _write_records(spark, sf_dir, folder, parts=3):
    rows = accounts(spark, sf_dir).withColumn("part", F.col("account_id") % parts).persist()
    for i in range(parts):
        rows.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(folder))
    return rows.drop("part")


def test_stream_scores_equal_batch_and_drop_repeats(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    rows = _write_records(spark, sf_dir, source)
    rows.limit(50).coalesce(1).write.mode("append").parquet(str(source))  # repeats
    stream = jobs.read_files(spark, str(source), S.account_schema(), files_per_batch=2)
    paths = [str(tmp_path / n) for n in ("log", "aside", "progress")]
    jobs.score_stream(stream, DEFAULT_CARD.score, _at(), *paths).awaitTermination()
    log = audit.read_audit(spark, paths[0])
    aside = spark.read.parquet(paths[1])
    assert log.count() + aside.count() == rows.count()
    assert aside.count() == rows.where("TotalCharges is null").count()
    good = rows.where("TotalCharges is not null")
    batch = audit.audit_rows(scoring.score_records(good, DEFAULT_CARD.score), _at(), good.columns)
    names = ["prediction_id", "probability", "risk_tier", "clv_estimate"]
    assert log.select(*names).exceptAll(batch.select(*names)).isEmpty()
    # Nothing new: a restart adds nothing.
    jobs.score_stream(stream, DEFAULT_CARD.score, _at(), *paths).awaitTermination()
    assert audit.read_audit(spark, paths[0]).count() == log.count()


def test_stream_writes_few_files_and_reads_its_batch_once(spark, sf_dir, tmp_path):
    """Without adaptive execution a hint to rebalance does nothing; a month's rows go to one task, or its pieces."""
    source = tmp_path / "in"
    rows = _write_records(spark, sf_dir, source)
    stream = jobs.read_files(spark, str(source), S.account_schema())
    paths = [str(tmp_path / n) for n in ("log", "aside", "progress")]
    query = jobs.score_stream(stream, DEFAULT_CARD.score, _at(), *paths)
    query.awaitTermination()
    for path in paths[:2]:
        files = [f.parent for f in (tmp_path / path).rglob("*.parquet")]
        assert len(files) == len(set(files)) > 1
    assert audit.read_audit(spark, paths[0]).count() + spark.read.parquet(paths[1]).count() == rows.count()
    # in whatever pieces a month is written, a record that comes twice is kept once
    good = rows.where("TotalCharges is not null").withColumn("signup_date", F.lit("2020-05-06").cast("date"))
    scored = audit.audit_rows(scoring.score_records(good, DEFAULT_CARD.score), _at(), good.columns)
    audit.append_new(scored.union(scored), str(tmp_path / "pieces"), "a", 2)
    assert audit.read_audit(spark, str(tmp_path / "pieces")).count() == good.count()
    assert audit.pieces(10) == 1 and audit.pieces(10 * audit.PIECE_ROWS) == 11


def test_late_records_reach_a_log(spark, sf_dir, tmp_path):
    """The second micro-batch is years older than the first; nothing may vanish."""
    rows = accounts(spark, sf_dir).persist()
    middle = rows.agg(F.percentile_approx(F.unix_date("signup_date"), 0.5)).first()[0]
    newer = F.unix_date("signup_date") >= middle
    paths = [str(tmp_path / n) for n in ("log", "aside", "progress")]
    for part in (newer, ~newer):
        rows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_files(spark, str(tmp_path / "in"), S.account_schema())
        jobs.score_stream(stream, DEFAULT_CARD.score, _at(), *paths).awaitTermination()
    ids = audit.read_audit(spark, paths[0]).select("prediction_id").union(spark.read.parquet(paths[1]).select("prediction_id"))
    assert ids.count() == ids.distinct().count() == rows.count()


def test_records_without_time_or_key_are_kept(spark, sf_dir, tmp_path):
    """Each different record is in one of the two, however often it comes; two inputs of one second are two records."""
    rows = accounts(spark, sf_dir).where("TotalCharges is not null").limit(9).persist()
    untimed = rows.withColumn("signup_date", F.lit(None).cast("date"))
    keyless = rows.withColumn(S.KEY, F.lit(None).cast("long"))
    again = rows.withColumn("MonthlyCharges", F.col("MonthlyCharges") + 1)
    every = rows.unionByName(untimed).unionByName(keyless).unionByName(again)
    both = untimed.withColumn(S.KEY, F.lit(None).cast("long"))
    paths = [str(tmp_path / n) for n in ("log", "aside", "progress")]
    for part in (every, every, both):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_files(spark, str(tmp_path / "in"), S.account_schema())
        jobs.score_stream(stream, DEFAULT_CARD.score, _at(), *paths).awaitTermination()
    log = audit.read_audit(spark, paths[0]).collect()
    schema = "prediction_id string, input_json string, errors array<string>"
    aside = spark.read.schema(schema).parquet(paths[1]).collect()
    assert len(log) == 18 and len({r.input_json for r in log}) == 18
    codes = sorted((tuple(e for e in r.errors if "missing" in e) for r in aside))
    names = (f"{S.KEY}:missing", "time:missing")
    want = [(names[1],)] * untimed.distinct().count() + [(names[0], names[1])] * both.distinct().count()
    # without a key there is no second of the day either, so no time
    want += [(names[0], names[1])] * keyless.distinct().count()
    assert codes == sorted(want)
    assert len({r.prediction_id for r in aside}) == len(aside) and all(r.prediction_id for r in aside)


def test_batch_log_keeps_untimed_rows(spark, sf_dir, tmp_path):
    scored = scoring.score_records(accounts(spark, sf_dir), DEFAULT_CARD.score).limit(20).persist()
    rows = audit.audit_rows(scored, F.lit(None).cast("timestamp"), ["account_id", "tenure"])
    for batch in ("a", "a", "b"):
        audit.append_rows(rows, str(tmp_path / "log"), batch)
    assert audit.read_audit(spark, str(tmp_path / "log")).count() == 20


def test_window_store_is_merged(spark, tmp_path):
    """After many micro-batches the state is one snapshot and few deltas, and the same as without merging."""
    base = datetime.datetime(2024, 1, 1)
    paths = {n: str(tmp_path / f"out{n}") for n in (2, 1000)}
    for part in range(7):
        rows = [(part, base + datetime.timedelta(hours=part * 5 + k), k % 3, "view", 1.0, "{}") for k in range(6)]
        spark.createDataFrame(rows, S.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), S.EVENT_SCHEMA, files_per_batch=1)
    sums = jobs.user_features(stream, jobs.time_window("at_time", "12 hours"), late="30 days")
    keys = ["user_id", "start"]
    for n, path in paths.items():
        jobs.write_updates(sums, path, str(tmp_path / f"progress{n}"), keys, merge_after=n).awaitTermination()
    got = {n: sorted(map(str, jobs.latest(spark, path, sums.schema, keys).collect())) for n, path in paths.items()}
    assert got[2] == got[1000] and len(got[2]) > 6
    assert jobs._complete(spark, f"{paths[2]}/snapshot")[-1] >= 5
    files = jobs.latest(spark, paths[2], sums.schema, keys).inputFiles()
    assert len({f.rsplit("/", 1)[0] for f in files}) <= 2


def _events(spark, folder):
    base = datetime.datetime(2024, 1, 1)
    rows = [
        (1, base, 7, "view", 1.0, "{}"),
        (2, base + datetime.timedelta(minutes=20), 7, "purchase", 5.0, "{}"),
        (3, base + datetime.timedelta(hours=3), 7, "error", 1.0, "{}"),
        (4, base + datetime.timedelta(hours=3), 8, "click", 1.0, "{}"),
        (5, base + datetime.timedelta(days=2), 8, "click", 1.0, "{}"),
    ]
    spark.createDataFrame(rows, S.EVENT_SCHEMA).coalesce(1).write.parquet(str(folder))
    return jobs.read_files(spark, str(folder), S.EVENT_SCHEMA)


def test_sliding_windows(spark, tmp_path):
    stream = _events(spark, tmp_path / "in")
    sums = jobs.user_features(stream, jobs.time_window("at_time", "2 hours", "1 hour"), late="1 hour")
    keys = ["user_id", "start"]
    jobs.write_updates(sums, str(tmp_path / "out"), str(tmp_path / "progress"), keys).awaitTermination()
    rows = jobs.latest(spark, str(tmp_path / "out"), sums.schema, ["user_id", "start"]).collect()
    # Every event lies in two windows; the first two events share theirs.
    assert len(rows) == 8
    assert sum(r.number_of_logins for r in rows) == 6
    assert sum(r.usage_value for r in rows) == 10.0


def test_session_windows_close_in_append_mode(spark, tmp_path):
    stream = _events(spark, tmp_path / "in")
    sums = jobs.user_features(stream, jobs.time_window("at_time", "1 hour", session=True), late="1 minute")
    jobs.closed_windows(sums, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    rows = spark.read.schema(sums.schema).parquet(str(tmp_path / "out")).collect()
    # The session of the newest event is still open.
    assert sorted((r.user_id, r.number_of_logins, r.complaints_count) for r in rows) == [(7, 0, 1), (7, 1, 0), (8, 1, 0)]


def test_top_driver_order_and_direction(spark, sf_dir):
    from holdfast.operators import attribution as A

    names = list(DEFAULT_CARD.weights)
    explained = A.linear_attributions(featured_accounts(spark, sf_dir), DEFAULT_CARD)
    for r in A.top_drivers(explained, names, 8).limit(20).collect():
        sizes = [abs(d.contribution) for d in r.drivers]
        assert len(sizes) == 8 and sizes == sorted(sizes, reverse=True)
        assert all((d.contribution > 0) == (d.direction == "increases risk") for d in r.drivers)


def test_written_log_joins_its_records_once(spark, sf_dir, monkeypatch):
    """The batch job, its retry and the second batch read the same kept records, which are given back."""
    from holdfast.catalog import streams

    plans, append = [], streams.audit.append_audit

    def noted(part, path, batch):
        plans.append(part._jdf.queryExecution().optimizedPlan().toString())
        append(part, path, batch)

    monkeypatch.setattr(streams.audit, "append_audit", noted)
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    assert len(load()[0]["audit_written_log"](spark, sf_dir).collect()) == 4
    assert len(plans) == 3 and all("InMemoryRelation" in p.split("Join")[0] and "Join" not in p.split("InMemoryRelation")[0] for p in plans)
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before
