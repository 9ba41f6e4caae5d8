"""A ledger in a folder to which one writer at a time appends.

``data/`` holds Parquet that nobody reads by itself; ``commits/`` has one small file for each commit, numbered
from 1, that names the data it adds.  A writer works on the version that it read and puts its commit under
the next number, which fails if somebody else did so first: one of two writers loses, and has changed
nothing.  Nothing is ever edited or deleted, and readers see whole commits only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import ledger as L


class Conflict(RuntimeError):
    """Another writer committed first."""


class Refused(ValueError):
    """Some rows may not be written."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, path: str) -> list[str]:
    """Paths of the commit files in the order of their numbers."""
    files, folder = _files(spark, path), _path(spark, f"{path}/commits")
    if not files.exists(folder):
        return []
    return sorted(s.getPath().toString() for s in files.listStatus(folder) if s.getPath().getName()[:-5].isdigit())


def version(spark: SparkSession, path: str) -> int:
    """The number of the last commit; 0 before the first."""
    return len(_commits(spark, path))


def read(spark: SparkSession, path: str, at: int | None = None) -> DataFrame | None:
    """All rows of the ledger as of a version (the last, if not given); None before the first commit."""
    names = _commits(spark, path)[:at]
    if not names:
        return None
    said = [json.loads(r.value) for r in spark.read.text(names).collect()]  # one line each
    return spark.read.parquet(*[f"{path}/data/{c['data']}" for c in said])


def _put(spark: SparkSession, path: str, number: int, content: str) -> None:
    """Writes commit ``number`` whole or not at all; fails if it exists."""
    jvm = spark._jvm
    own, target = _path(spark, f"{path}/commits/.{uuid.uuid4().hex}"), _path(spark, f"{path}/commits/{number:020d}.json")
    files = _files(spark, path)
    files.mkdirs(_path(spark, f"{path}/commits"))
    stream = files.create(own, False)
    stream.write(content.encode())
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        # a rename that does not replace; at once where the file system can do so
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(own).toUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(own), files.makeQualified(target), options)
    except Exception as error:
        files.delete(own, False)
        if files.exists(target):
            raise Conflict(f"version {number} is there already") from error
        raise


def append(path: str, decisions: DataFrame, events: DataFrame, expected: int | None = None) -> int:
    """Appends decisions (``ledger.CONTENT``, chain, seq) to the ledger at ``path``; the new version comes back.

    ``expected`` is the version that the decisions were made on, the last one if not given.  If it is not the last one any more,
    Conflict is raised and nothing changes; so it is if another writer commits meanwhile.  Decisions that ``ledger.refusals``
    has something against are Refused as a whole.  ``seq`` orders the rows of one commit (up to 2**40); commits follow each other.  No decisions make a commit all the same.
    """
    spark = decisions.sparkSession
    now = version(spark, path)
    if expected is not None and expected != now:
        raise Conflict(f"made on version {expected}, but the last one is {now}")
    wrong = L.refusals(decisions, events).limit(5).collect()
    if wrong:
        raise Refused("; ".join(f"{r.decision_id}: {r.reason}" for r in wrong))
    data = uuid.uuid4().hex
    L.append(read(spark, path, now), decisions.withColumn("seq", F.lit((now + 1) << 40) + F.pmod("seq", F.lit(1 << 40)))).write.parquet(f"{path}/data/{data}")
    try:
        _put(spark, path, now + 1, json.dumps({"data": data, "version": now + 1}))
    except Conflict:
        _files(spark, path).delete(_path(spark, f"{path}/data/{data}"), True)
        raise
    return now + 1


def correct(path: str, corrections: DataFrame, events: DataFrame, expected: int | None = None) -> int:
    """Appends corrections (``append``'s columns but supersedes): each supersedes the decision that stands for its event.

    A correction of an event without a standing decision, and a second one of the same event at once, are Refused.
    """
    spark = corrections.sparkSession
    now = version(spark, path) if expected is None else expected
    before = read(spark, path, now)
    if before is None:
        raise Refused("nothing to correct")
    stands = L.current(before).groupBy("event_id").agg(F.max_by("decision_id", F.struct("decided_at", "decision_id")).alias("supersedes"))
    rows = corrections.drop("supersedes").join(stands, "event_id", "left")
    if not rows.where("supersedes is null").isEmpty():
        raise Refused("no standing decision to correct")
    if not rows.groupBy("supersedes").count().where("count > 1").isEmpty():
        raise Refused("one decision is corrected twice")
    return append(path, rows, events, now)
