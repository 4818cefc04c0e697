"""Snapshot runs: the rules of phases, and streams that are killed and go on."""

import datetime
import shutil

import pytest

from foliant.streaming import snapshot

EVENT = "run string, seq long, at timestamp, event string, facts string"
WHOLE = ["prepare", "capability", "identity", "plan", "extract", "normalize", "validate", "stage", "extract", "normalize", "validate", "stage", "reconcile", "commit_pending", "receipt", "completed"]


def test_rules():
    phase, facts, outcomes = "", None, []
    for event in WHOLE:
        phase, facts, outcome = snapshot.step(phase, facts, event, "f")
        outcomes.append(outcome)
    assert phase == "completed" and set(outcomes) == {"moved"}
    assert snapshot.step("completed", None, "prepare", None)[2] == "terminal"
    assert snapshot.step("extract", None, "stage", None) == ("extract", None, "refused")
    assert snapshot.step("extract", None, "plan", None) == ("plan", None, "moved")
    assert snapshot.step("commit_pending", "f", "receipt", "g") == ("failed", None, "receipt_mismatch")
    assert snapshot.step("commit_pending", "f", "prepare", None)[2] == "refused" and snapshot.step("stage", None, "receipt", "f")[2] == "refused"
    assert snapshot.step("commit_pending", "f", "cancelled", None) == ("cancelled", None, "moved")


def events(spark, names, runs=("a", "b", None), start=1, later=0):
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    return spark.createDataFrame([(r, i, at + datetime.timedelta(minutes=i + later), e, "f") for r in runs for i, e in enumerate(names, start)], EVENT)


@pytest.fixture
def stores(spark):
    spark.conf.set(*snapshot.STATE_STORE)
    yield
    spark.conf.unset(snapshot.STATE_STORE[0])


def run(spark, folder, die_at=None, wait=None, late="1 day"):
    """Read what is in the folder, a micro-batch a file; dies after having written the die_at-th batch but before that is known."""

    def write(rows, batch):
        rows.write.mode("overwrite").parquet(f"{folder}/out/part={batch}")
        if batch == die_at:
            raise InterruptedError("killed")

    stream = snapshot.outcomes(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), wait, late)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()


def found(spark, folder):
    return sorted((str(r["run"]), r["seq"], r["event"], r["phase"], r["outcome"]) for r in spark.read.parquet(f"{folder}/out").collect())


def test_a_killed_stream_gives_the_rows_of_an_unbroken_one(spark, tmp_path, stores):
    parts = [WHOLE[:4], WHOLE[4:9], WHOLE[9:14], WHOLE[14:]]
    start = 1
    for name in ("whole", "killed"):
        start = 1
        for i, part in enumerate(parts):
            events(spark, part, start=start).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            start += len(part)
            if name == "killed" and i in (1, 3):
                with pytest.raises(Exception, match="killed"):
                    run(spark, f"{tmp_path}/{name}", die_at=i)
                shutil.rmtree(f"{tmp_path}/{name}/out/part={i}")  # what the killed batch wrote is lost as well
                run(spark, f"{tmp_path}/{name}")
        if name == "whole":
            run(spark, f"{tmp_path}/{name}")
    assert found(spark, f"{tmp_path}/killed") == found(spark, f"{tmp_path}/whole")
    assert {(r[3], r[4]) for r in found(spark, f"{tmp_path}/whole") if r[1] == len(WHOLE)} == {("completed", "moved")}


def test_replays_gaps_and_a_commit_that_waits(spark, tmp_path, stores):
    folder = f"{tmp_path}/x"
    steps = [(WHOLE[:14], ("a", "b"), 1, 0), (WHOLE[:2], ("a",), 1, 0), (["prepare"], ("late",), 2, 200), (WHOLE[14:], ("a",), 15, 200), (["prepare"], ("later",), 2, 500)]
    for names, runs, first, later in steps:
        events(spark, names, runs, first, later).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run(spark, folder, wait="1 hour", late="2 hours")
    rows = found(spark, folder)
    assert [r for r in rows if r[4] == "replayed"] == [("a", 1, "prepare", "commit_pending", "replayed"), ("a", 2, "capability", "commit_pending", "replayed")]
    assert [r[0] for r in rows if r[4] == "gap"] == ["late", "later"]
    assert [r for r in rows if r[4] == "resume"] == [("a", 14, "timer", "commit_pending", "resume"), ("b", 14, "timer", "commit_pending", "resume")]
    assert ("a", 16, "completed", "completed", "moved") in rows
