import random

from pyspark.sql import functions as F

from shelfmark.functions import scalar as X
from shelfmark.operators import command_log as M


def one_by_one(libraries, removing, log):
    """Renames applied in order, and the libraries afterwards."""
    rows, out = {i: [n, r] for i, n, r in libraries}, []
    for seq, i, expected, name in sorted(log):
        row = rows.get(i)
        if row is None:
            outcome = "not_found"
        elif row[1] != expected:
            outcome = "precondition_failed"
        elif i in removing:
            outcome = "removal_active"
        elif row[0] == name:
            outcome = "unchanged"
        elif any(j != i and X.fold(r[0]) == X.fold(name) for j, r in rows.items()):
            outcome = "name_exists"
        else:
            outcome = "renamed"
            row[:] = [name, expected + 1]
        out.append((seq, i, outcome, *(row or [None, None])))
    return sorted(out), sorted((i, n, r) for i, (n, r) in rows.items())


def test_renames_are_one_by_one(spark):
    """Many commands on one library, and many libraries after one name, some of them freed in between."""
    rng = random.Random(4)
    for libs, names, n in ((2, 2, 12), (6, 5, 90), (40, 30, 400)):
        libraries = [(i, f"Name {i}", rng.randrange(3)) for i in range(libs)]
        log = [(k, rng.randrange(libs + 1), rng.randrange(6), rng.choice([f"Name {rng.randrange(names)}", f"NAME {rng.randrange(names)}", f"Straße {rng.randrange(3)}", f"STRASSE {rng.randrange(3)}"])) for k in range(n)]
        removing = {1}
        got = M.renames(
            spark.createDataFrame(libraries, "id long, name string, revision long"),
            spark.createDataFrame([(1, "running"), (0, "failed")], "library_id long, status string"),
            spark.createDataFrame(log, "seq long, id long, expected_revision long, name string"),
        ).collect()
        want, left = one_by_one(libraries, removing, log)
        assert sorted(tuple(r) for r in got if r["seq"] is not None) == want
        assert sorted((r["id"], r["name"], r["revision"]) for r in got if r["seq"] is None) == left
        assert n < 50 or {"renamed", "name_exists", "precondition_failed", "not_found"} <= {w[2] for w in want}


def test_rounds_leave_out_what_is_settled(spark, monkeypatch):
    """Names pass from hand to hand early in a log; the rounds that this takes don't go through the commands behind."""
    rng, folded, n = random.Random(4), M.folded, []
    monkeypatch.setattr(M, "FIRST", 64, raising=False)
    monkeypatch.setattr(M, "folded", lambda rows, log, *more: n.append(log.count()) or folded(rows, log, *more))
    libraries = [(i, f"Name {i}", 0) for i in range(6)]
    log = [(k, rng.randrange(7), rng.randrange(4) if k < 60 else 9, f"Other {rng.randrange(3)}") for k in range(3000)]
    log[2500] = (2500, 0, 40, "Name 9")
    want, left = one_by_one(libraries, {1}, log)
    frames = spark.createDataFrame(libraries, "id long, name string, revision long"), spark.createDataFrame([(1, "running")], "library_id long, status string"), spark.createDataFrame(log, "seq long, id long, expected_revision long, name string")
    got = M.renames(*frames).collect()
    assert sorted(tuple(r) for r in got if r["seq"] is not None) == want
    assert sorted((r["id"], r["name"], r["revision"]) for r in got if r["seq"] is None) == left
    assert len(n) > 5 and sum(n) < 2 * len(log)


def test_two_after_one_name(spark):
    libraries = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, name string, revision long")
    log = spark.createDataFrame([(1, 1, 1, "same"), (2, 2, 1, "SAME")], "seq long, id long, expected_revision long, name string")
    none = spark.createDataFrame([], "library_id long, status string")
    assert [r["outcome"] for r in M.renames(libraries, none, log).filter("seq is not null").orderBy("seq").collect()] == ["renamed", "name_exists"]
    assert M.renames(libraries, none, log.limit(0)).count() == 2
    assert M.renames(libraries.limit(0), none, log).filter("outcome <> 'not_found'").isEmpty()


def test_updates_are_one_by_one(spark):
    rng = random.Random(7)
    rows = {i: [rng.randrange(3), f"v{i}"] for i in range(20)}
    log = [(k, 0 if rng.random() < 0.4 else rng.randrange(22), rng.choice([0, 1, 2, 3, 4, None]), f"w{k}") for k in range(600)]
    df = spark.createDataFrame([(i, r, v) for i, (r, v) in rows.items()], "id long, revision long, name string")
    got = M.updates(df, spark.createDataFrame(rng.sample(log, len(log)), "seq long, id long, expected_revision long, value string"), "name").collect()
    want = []
    for seq, i, e, v in log:
        outcome = "not_found" if i not in rows else "applied" if rows[i][0] == e else "precondition_failed"
        if outcome == "applied":
            rows[i] = [e + 1, v]
        want.append((seq, i, outcome, *rows.get(i, (None, None))))
    assert sorted(tuple(r) for r in got if r["seq"] is not None) == want
    assert sorted((r["id"], r["revision"], r["name"]) for r in got if r["seq"] is None) == sorted((i, *v) for i, v in rows.items())


def test_phases_are_one_by_one(spark):
    rng = random.Random(9)
    phases = list(M.PHASES)
    runs = {i: [rng.choice(["running", "failed"]), rng.choice(phases), 3, None] for i in range(30)}
    log = [(k, rng.randrange(32), rng.choice([*phases, None]), 1000 + k) for k in range(200)]
    df = spark.createDataFrame([(i, *r) for i, r in runs.items()], "id long, status string, phase string, revision long, lease_expires_at_ms long")
    got = M.phases(df, spark.createDataFrame(log, "seq long, id long, phase string, at_ms long"), 50)
    for _, i, phase, at in log:
        if i in runs and runs[i][0] == "running":
            if phase and phases.index(phase) > phases.index(runs[i][1]):
                runs[i][1:3] = [phase, runs[i][2] + 1]
            runs[i][3] = at + 50
    assert sorted(map(tuple, got.collect())) == sorted((i, *r[1:]) for i, r in runs.items())
    assert got.filter(F.col("lease_expires_at_ms").isNotNull()).count() > 5
