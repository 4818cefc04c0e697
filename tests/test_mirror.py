"""The mirror's log: repeated, killed and raced steps, damaged logs."""

import contextlib
import json

import pytest

from foliant.sinks.mirror import OBSERVED, Mirror, MirrorConflict, publish


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/mirror"


def records(spark, *rows):
    return spark.createDataFrame(list(rows), OBSERVED)


def stored(mirror):
    return sorted((r["key"] or "", r["hash"] or "") for r in mirror.observed().collect())


def test_a_file_is_created_once(spark, tmp_path):
    uri = f"file://{tmp_path}/x.json"
    assert publish(spark, uri, b"first") and not publish(spark, uri, b"second")
    assert [p.name for p in tmp_path.iterdir()] == ["x.json"] and (tmp_path / "x.json").read_bytes() == b"first"


def test_verdicts(spark, folder):
    mirror = Mirror(spark, folder)
    rows = records(spark, ("a", "1", "x"), ("a", "1", "x"), ("b", "1", "x"), ("b", "2", "y"), (None, "1", "x"), ("c", None, "x"))
    assert {(r["key"], r["verdict"]) for r in mirror.observe("one", rows).collect()} == {("a", "inserted"), ("b", "conflict"), (None, "inserted"), ("c", "inserted")}
    again = records(spark, ("a", "1", "x"), (None, "2", "x"), ("c", None, "x"), ("d", "1", "x"))
    assert {(r["key"], r["verdict"]) for r in mirror.observe("two", again).collect()} == {("a", "replayed"), (None, "conflict"), ("c", "replayed"), ("d", "inserted")}
    assert stored(mirror) == [("", "1"), ("a", "1"), ("c", ""), ("d", "1")]
    assert mirror.commit("none") == "not_observed" and mirror.commit("two") == "conflict" and mirror.commit("one") == "conflict"
    assert mirror.observe("empty", records(spark)).count() == 0 and mirror.commit("empty") == "committed"


def test_a_batch_that_runs_again_changes_nothing(spark, folder):
    mirror, rows = Mirror(spark, folder), records(spark, ("a", "1", "x"), ("b", "1", "x"))
    position = spark.createDataFrame([("c", "p", "here")], "company string, pack string, position string")
    event = spark.createDataFrame([("s", 1, "pending", "")], "stream string, at long, kind string, body string")
    before = None
    for turn in range(3):
        again = Mirror(spark, folder)
        assert sorted(r["verdict"] for r in again.observe("one", rows.repartition(turn + 1)).collect()) == ["inserted", "inserted"]
        assert again.commit("one", position) == ("committed" if turn == 0 else "already_committed")
        again.checkpoint("later", position)
        again.log("l", event)
        now = (again.entries(), stored(again), [tuple(r) for r in again.checkpoints().collect()], [tuple(r) for r in again.pending().collect()])
        assert before in (None, now)
        before = now
    assert before[2] == [("c", "p", "here", 2)] and before[3] == [("s", "pending", 1)]
    with pytest.raises(MirrorConflict):
        mirror.observe("one", rows.limit(1))
    assert stored(mirror) == [("a", "1"), ("b", "1")]


def test_killed_between_any_two_steps(spark, folder, monkeypatch):
    """A writer that dies at its n-th write or entry leaves a state from which the whole batch runs again."""
    rows = records(spark, ("a", "1", "x"), ("b", "1", "x"))
    position = spark.createDataFrame([("c", "p", "here")], "company string, pack string, position string")
    for at in range(1, 6):
        mirror, steps = Mirror(spark, f"{folder}{at}"), []

        def dying(step, steps=steps, at=at):
            def run(*args):
                steps.append(step)
                if len(steps) == at:
                    raise InterruptedError
                return step(*args)

            return run

        with monkeypatch.context() as m, contextlib.suppress(InterruptedError):
            m.setattr(mirror, "_write", dying(mirror._write))
            m.setattr(mirror, "_publish", dying(mirror._publish))
            mirror.observe("one", rows)
            mirror.commit("one", position)
        seen = Mirror(spark, f"{folder}{at}")
        kinds = [e["kind"] for e in seen.entries()]
        assert kinds == ["observe", "commit"][: (at - 1) // 2] and seen.checkpoints().count() == kinds.count("commit")
        seen.observe("one", rows)
        assert seen.commit("one", position) in ("committed", "already_committed")
        assert stored(seen) == [("a", "1"), ("b", "1")] and len(seen.entries()) == 2


def test_of_two_writers_one_takes_a_number(spark, folder):
    first, second = Mirror(spark, folder), Mirror(spark, folder)
    publish_second = second._publish

    def late(entry):
        second._publish = publish_second
        first.observe("first", records(spark, ("a", "1", "x")))
        return publish_second(entry)

    second._publish = late
    found = second.observe("second", records(spark, ("a", "2", "x"), ("b", "1", "x"))).collect()
    assert {(r["key"], r["verdict"]) for r in found} == {("a", "conflict"), ("b", "inserted")}
    assert stored(first) == [("a", "1"), ("b", "1")] and [e["batch"] for e in first.entries()] == ["first", "second"]


def test_a_checkpoint_moves_on_from_where_it_is_expected(spark, folder):
    mirror = Mirror(spark, folder)
    at = lambda p: spark.createDataFrame([("c", "p", p)], "company string, pack string, position string")
    for batch in ("one", "two", "three"):
        mirror.observe(batch, records(spark, (batch, "1", "x")))
    assert mirror.commit("one", at("1"), {("c", "p"): "0"}) == "concurrent_checkpoint"
    assert mirror.commit("one", at("1"), {("c", "p"): None}) == "committed"
    assert mirror.commit("two", at("2"), {("c", "p"): None}) == "concurrent_checkpoint"
    assert mirror.commit("two", at("2"), {("c", "p"): "1"}) == "committed"
    assert [tuple(r) for r in mirror.checkpoints().collect()] == [("c", "p", "2", 2)]


def test_a_damaged_log_is_an_error(spark, folder, tmp_path):
    mirror = Mirror(spark, folder)
    mirror.observe("one", records(spark, ("a", "1", "x")))
    mirror.observe("two", records(spark, ("b", "1", "x")))
    log = tmp_path / "mirror" / "log"
    first = log / f"{1:012d}.json"
    kept = first.read_bytes()
    first.unlink()
    with pytest.raises(ValueError, match="gaps"):
        mirror.observed()
    entry = json.loads(kept)
    first.write_text(json.dumps({**entry, "path": entry["path"] + "-gone"}))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        mirror.observed().count()
