"""Logs of commands, applied one after the other: every command gets an outcome, and every row what the log leaves of it.

A key's commands stand in the order of `seq`, and each sees what the ones before it did. The log is dealt by key and sorted
within tasks; a task streams through it and holds the state of one key, so a key with a third of all commands needs no more
memory than another. Commands that compete for something unique across keys (names) are settled in rounds: each round
folds the log with what it knows of who held what when, until a round learns nothing new. By then every command has seen
what the ones before it did, as if the log had been applied in one go. A long log is settled in stretches, so that rounds
go through the commands that still learn something. `seq` must be unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import scalar as X
from shelfmark.operators.commits import PHASES
from shelfmark.staging import staged

#: Commands of the first stretch that renames settles.
FIRST = 65_536
Step = Callable[[dict | None, dict], tuple[dict | None, str]]


def folded(rows: DataFrame, log: DataFrame, key: str, step: Step, told: str) -> DataFrame:
    """(seq, key, outcome, and the columns `told` of the state after it) of every command, and a row with a null seq of what each row of `rows` is in the end.

    step(state, command) gives the state after a command and its outcome; state is None where there is no such row. told is a DDL string of state columns.
    """
    state = [c for c in rows.columns if c != key]
    asked = [c for c in log.columns if c not in (key, "seq")]
    kind = {**dict(rows.dtypes), **{f"c_{c}": t for c, t in log.dtypes}}
    blank = lambda c: F.lit(None).cast(kind[c]).alias(c)
    first = rows.select(F.col(key).cast("long").alias(key), F.lit(None).cast("long").alias("seq"), *state, *[blank(f"c_{c}") for c in asked])
    then = log.select(F.col(key).cast("long").alias(key), F.col("seq").cast("long").alias("seq"), *[blank(c) for c in state], *[F.col(c).alias(f"c_{c}") for c in asked])
    lined = first.unionByName(then).repartition(key).sortWithinPartitions(key, F.col("seq").asc_nulls_first())
    names = [t.split()[0] for t in told.split(", ")]
    out = f"seq long, {key} long, outcome string, {told}"
    schema = lined.sparkSession.createDataFrame([], out).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        now, held, there = None, None, False
        end = lambda: [(None, now, None, *[held[c] for c in names])] if there and held is not None else []
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if not there or row[key] != now:
                    done += end()
                    now, held, there = row[key], None, True
                if row["seq"] is None:
                    held = {c: row[c] for c in state}
                else:
                    held, outcome = step(held, {c: row[f"c_{c}"] for c in asked})
                    done.append((row["seq"], now, outcome, *[held[c] if held is not None else None for c in names]))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
        if done := end():
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)

    return lined.mapInArrow(run, schema)


def _by_revision(row: dict | None, command: dict) -> tuple[dict | None, str]:
    if row is None:
        return None, "not_found"
    if command["expected_revision"] is None or row["revision"] != command["expected_revision"]:
        return row, "precondition_failed"
    return {"revision": row["revision"] + 1, "value": command["value"]}, "applied"


def updates(rows: DataFrame, log: DataFrame, column: str) -> DataFrame:
    """rows(id, revision, column) and log(seq, id, expected_revision, value): (seq, id, outcome, revision, column) of commands, and with a null seq of rows. A command applies where the row has the expected revision by then."""
    kind = dict(rows.dtypes)[column]
    out = folded(rows.select("id", F.col("revision").cast("long").alias("revision"), F.col(column).alias("value")), log.select("seq", "id", F.col("expected_revision").cast("long").alias("expected_revision"), F.col("value").cast(kind).alias("value")), "id", _by_revision, f"revision long, value {kind}")
    return out.withColumnRenamed("value", column)


def phases(runs: DataFrame, log: DataFrame, lease_ms: int) -> DataFrame:
    """(id, phase, revision, lease_expires_at_ms) of runs(id, status, phase, revision, lease_expires_at_ms) after log(seq, id, phase, at_ms): a running scan's phase only goes up, each step of which is a revision; every command is a sign of life.

    A step up is a new highest phase so far, so a running maximum tells them.
    """
    rank = lambda c: F.coalesce(F.array_position(F.array(*[F.lit(x) for x in PHASES]), c), F.lit(0))
    now = runs.filter("status = 'running'").select("id", rank(F.col("phase")).alias("begun"))
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ranked = log.join(now, "id").select("id", "seq", "at_ms", "begun", rank(F.col("phase")).alias("rank"))
    steps = ranked.withColumn("up", F.col("rank") > F.greatest("begun", F.coalesce(F.max("rank").over(before), F.lit(0))))
    ends = steps.groupBy("id").agg(F.max("rank").alias("to"), F.count_if("up").alias("ups"), F.max_by("at_ms", "seq").alias("at_ms"))
    met = runs.join(ends, "id", "left")
    phase = F.when(F.col("ups") > 0, F.element_at(F.array(*[F.lit(x) for x in PHASES]), F.greatest("to", F.lit(1)).cast("int"))).otherwise(F.col("phase"))
    return met.select("id", phase.alias("phase"), (F.col("revision") + F.coalesce("ups", F.lit(0))).alias("revision"), F.coalesce(F.col("at_ms") + lease_ms, F.col("lease_expires_at_ms")).alias("lease_expires_at_ms"))


def _rename(row: dict | None, command: dict) -> tuple[dict | None, str]:
    if row is None:
        return None, "not_found"
    row = {**row, "left_key": None}
    if row["revision"] != command["expected_revision"]:
        return row, "precondition_failed"
    if row["removing"]:
        return row, "removal_active"
    if row["name"] == command["name"]:
        return row, "unchanged"
    if not command["free"]:
        return row, "name_exists"
    return {**row, "revision": row["revision"] + 1, "name": command["name"], "name_key": command["name_key"], "left_key": row["name_key"]}, "renamed"


def _settled(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The fold of commands that compete for names, in rounds until no command learns more of who holds its name. asked must be a table."""
    held = rows.groupBy("name_key").agg(F.min("id").alias("holder"))
    known = staged(asked.join(held, "name_key", "left").select(*asked.columns, F.coalesce(F.col("holder") == F.col("id"), F.col("holder").isNull()).alias("free")), "free")
    while True:
        done = staged(folded(rows, known, "id", _rename, "name string, name_key string, revision long, removing boolean, left_key string"), "renamed")
        took = done.filter("outcome = 'renamed'")
        # who holds a name: from the start, from a rename to it, or nobody after a rename away from it
        events = held.select("name_key", F.lit(-1).alias("after"), F.lit(None).cast("long").alias("seq"), F.struct(F.col("holder")).alias("holds"))
        events = events.unionByName(took.select("name_key", F.lit(1).alias("after"), "seq", F.struct(F.col("id").alias("holder")).alias("holds")))
        events = events.unionByName(took.filter("left_key <> name_key").select(F.col("left_key").alias("name_key"), F.lit(1).alias("after"), "seq", F.struct(F.lit(None).cast("long").alias("holder")).alias("holds")))
        looks = known.select("name_key", F.lit(0).alias("after"), "seq", F.lit(None).cast("struct<holder:bigint>").alias("holds"), *[c for c in known.columns if c not in ("name_key", "seq")])
        past = Window.partitionBy("name_key").orderBy(F.col("seq").asc_nulls_first(), "after").rowsBetween(Window.unboundedPreceding, -1)
        seen = looks.unionByName(events, allowMissingColumns=True).withColumn("last", F.last("holds", ignorenulls=True).over(past)).filter("after = 0")
        free = F.col("last.holder").isNull() | (F.col("last.holder") == F.col("id"))
        better = staged(seen.select(*[c for c in known.columns if c != "free"], free.alias("free"), (free != F.col("free")).alias("new")), "free")
        if better.filter("new").isEmpty():
            return done
        known = better.drop("new")


def _stretches(asked: DataFrame) -> list[DataFrame]:
    """The log in stretches that follow one another, each as long as three times all before it."""
    n, ends = asked.count(), []
    while FIRST * 4 ** len(ends) < n:
        ends.append(FIRST * 4 ** len(ends) / n)
    marks = sorted(set(asked.agg(F.percentile_approx("seq", ends, 10_000)).first()[0])) if ends else []
    out = [asked.filter(F.col("seq") <= b) for b in marks[:1]] + [asked.filter((F.col("seq") > a) & (F.col("seq") <= b)) for a, b in zip(marks, marks[1:], strict=False)]
    return [*out, asked.filter(F.col("seq") > marks[-1]) if marks else asked]


def renames(libraries: DataFrame, removals: DataFrame, log: DataFrame) -> DataFrame:
    """(seq, id, outcome, name, revision) of every command of log(seq, id, expected_revision, name) on libraries(id, name, revision), and with a null seq of every library: by revision, unless a removal is active, to a name that no other library has by then when folded.

    A round is as long as what it folds, so the log is settled in stretches, and what a stretch leaves of the libraries is
    what the next begins with: rounds that names pass in early don't go through the commands behind them.
    """
    active = removals.filter(F.col("status").isin("queued", "running")).select(F.col("library_id").alias("id"), F.lit(True).alias("removing")).distinct()
    rows = libraries.join(active, "id", "left").select("id", "name", X.search_text_key(F.col("name")).alias("name_key"), F.col("revision").cast("long").alias("revision"), F.coalesce("removing", F.lit(False)).alias("removing"), F.lit(None).cast("string").alias("left_key"))
    rows = staged(rows, "named")
    asked = staged(log.select("seq", "id", F.col("expected_revision").cast("long").alias("expected_revision"), "name", X.search_text_key(F.col("name")).alias("name_key")), "renames")
    told = []
    for stretch in _stretches(asked):
        done = _settled(rows, stretch)
        told.append(done.filter("seq is not null"))
        rows = done.filter("seq is null").select(*rows.columns)
    return reduce(DataFrame.unionByName, [*told, done.filter("seq is null")]).select("seq", "id", "outcome", "name", "revision")
