import json
import os

import pytest

from histloom import params as pm
from histloom.operators import outputs, shared_files, staging
from histloom.plans import jobs
from tests.test_jobs import exports, read  # noqa: F401

P = pm.profile("default")


def snapshot(path):
    return {n: sorted(json.dumps(r, sort_keys=True) for r in read(f"{path}/{n}")) for n in sorted(os.listdir(path))
            if not n.startswith("_")}


def without_times(found):
    return {n: rows for n, rows in found.items() if n not in (jobs.REPORT, jobs.EXCLUDED_LOG)}


class Lost(BaseException):
    """The driver is gone."""


def fail_at(monkeypatch, name):
    """Writing the output ``name`` fails."""
    write = outputs.Outputs.write

    def broken(self, at, rows, text=False):
        if at == name:
            raise Lost
        write(self, at, rows, text)

    monkeypatch.setattr(outputs.Outputs, "write", broken)


def staged_folders(spark):
    root = staging.staging_root(spark)
    return [f for f in os.listdir(root) if f.startswith(("run-", "named-"))] if os.path.exists(root) else []


def test_resumes_between_two_outputs(exports, spark, tmp_path, monkeypatch):  # noqa: F811
    out, other = str(tmp_path / "out"), str(tmp_path / "other")
    old = pm.RunParams(P.filter, P.collect, "sharegpt", "commit_message")
    jobs.run(exports, old, out)
    before = snapshot(out)
    fail_at(monkeypatch, jobs.EXCLUDED_LOG)
    with pytest.raises(Lost):
        jobs.run(exports, P, out, name="nightly")
    # Two new outputs are written, none is to be seen; what was staged is kept.
    assert snapshot(out) == before and staged_folders(spark) == ["named-nightly"]
    assert outputs.current_path(spark, out, jobs.DATASET) == f"{out}/{jobs.DATASET}"
    assert outputs.recover(spark, out) == 0
    monkeypatch.undo()
    with pytest.raises(ValueError, match="other parameters"):
        jobs.run(exports, old, out, name="nightly")
    seen = []
    inner = staging.fs.complete
    monkeypatch.setattr(staging.fs, "complete", lambda s, p: seen.append((p, inner(s, p))) or seen[-1][1])
    report = jobs.run(exports, P, out, name="nightly").first()
    steps = [done for p, done in seen if "named-nightly" in p]
    # All steps but the report were there, and the two outputs.
    assert steps.count(False) == 1 and not steps[-1] and len(steps) > 5
    assert sum(done for p, done in seen if "_runs" in p) == 2
    jobs.run(exports, P, other)
    assert without_times(snapshot(out)) == without_times(snapshot(other)) != without_times(before)
    assert read(f"{out}/{jobs.REPORT}")[0]["run_id"] == report.run_id
    assert staged_folders(spark) == [] and not os.listdir(f"{out}/_runs")


def test_resumes_in_the_plan(exports, spark, tmp_path, monkeypatch):  # noqa: F811
    out, other = str(tmp_path / "out"), str(tmp_path / "other")
    from histloom.plans import dataset

    real = dataset.stage

    def broken(df, name):
        if name == "duplicates":
            raise Lost
        return real(df, name)

    monkeypatch.setattr(dataset, "stage", broken)
    with pytest.raises(Lost):
        jobs.run(exports, P, out, name="n.1")
    monkeypatch.undo()
    # A step half written is written anew.
    (folder,) = staged_folders(spark)
    steps = f"{staging.staging_root(spark)}/{folder}"
    half = next(f for f in sorted(os.listdir(steps)) if f.endswith("-pulls"))
    os.remove(f"{steps}/{half}/_SUCCESS")
    jobs.run(exports, P, out, name="n.1")
    jobs.run(exports, P, other)
    assert without_times(snapshot(out)) == without_times(snapshot(other))


def test_unnamed_run_leaves_nothing_behind(exports, spark, tmp_path, monkeypatch):  # noqa: F811
    out = str(tmp_path)
    fail_at(monkeypatch, jobs.REPORT)
    with pytest.raises(Lost):
        jobs.run(exports, P, out)
    assert staged_folders(spark) == [] and snapshot(out) == {}


@pytest.mark.parametrize("moves", range(1, 9))
def test_committed_outputs_are_moved_after_all(spark, tmp_path, monkeypatch, moves):
    out = str(tmp_path)

    def rows(n):
        return lambda: spark.range(n)

    first = outputs.Outputs(spark, out, "a")
    for name in ("x", "y", "z"):
        first.write(name, rows(1))
    first.publish(["x", "y", "z"])
    second = outputs.Outputs(spark, out, "b")
    for name in ("x", "y", "w"):
        second.write(name, rows(2))
    real, done = shared_files.move, []

    def breaking(s, source, target):
        done.append(source)
        if len(done) == moves:
            raise Lost
        real(s, source, target)

    monkeypatch.setattr(shared_files, "move", breaking)
    try:
        second.publish(["w", "x", "y", "z"])
        assert moves == 8  # the manifest, x, y and z set aside, x, y and w put in place
    except Lost:
        pass
    monkeypatch.undo()
    committed = moves > 1
    for name, n in {"x": 2, "y": 2, "w": 2}.items() if committed else {"x": 1, "y": 1, "z": 1}.items():
        assert spark.read.json(outputs.current_path(spark, out, name)).count() == n
    assert outputs.recover(spark, out) == (1 < moves < 8)
    found = {n: spark.read.json(f"{out}/{n}").count() for n in os.listdir(out) if n[0] != "_"}
    assert found == ({"x": 2, "y": 2, "w": 2} if committed else {"x": 1, "y": 1, "z": 1})


def test_names_of_runs(spark):
    for name in ("", "a/b", "..", "a b"):
        with pytest.raises(ValueError, match="name"), staging.staged_run(spark, name):
            pass
