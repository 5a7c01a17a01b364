"""Durable generation: answers are committed slice by slice while a run goes on, under a lock of the run folder.

A run's cells are dealt into numbered slices. Each slice is generated into a
staging folder and becomes part of the log by one rename, so a run that dies
keeps every slice that was committed, and a resumed run generates the rest.
The lock is a row of numbered claims: a claim is a file that only one writer
can create, its number is the fencing token, and a commit needs the highest.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.operators import runs

#: Cells in a slice, about; seconds that a claim holds without being renewed.
SLICE_CELLS, LEASE = 50_000, 3600.0


class RunLocked(RuntimeError):
    """Another writer holds the run folder."""


class RunFenced(RuntimeError):
    """A later claim has taken the run folder over; this writer's records are refused."""


class RunLock:
    """The right to append to a run folder, until it is released, taken over, or its lease ends."""

    def __init__(self, spark: SparkSession, run_dir: str, owner: str | None = None, lease: float = LEASE, clock: Callable[[], float] = time.time):
        self.path, self.owner, self.lease, self.clock, self.token = f"{run_dir}/_lock", owner or uuid.uuid4().hex, lease, clock, 0
        self._jvm = spark._jvm
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _claims(self) -> int:
        """The highest claim; 0 if there is none."""
        if not self._files.exists(self._at("")):
            return 0
        names = [s.getPath().getName() for s in self._files.listStatus(self._at(""))]
        return max((int(n.removeprefix("claim-")) for n in names if n.startswith("claim-")), default=0)

    def _state(self, token: int) -> dict:
        """What the claim's owner wrote last; a claim without it counts as fresh from the time of its file."""
        lease = self._at(f"lease-{token}")
        if self._files.exists(lease):
            stream = self._files.open(lease)
            try:
                text = self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(stream)).readLine()
            finally:
                stream.close()
            if text:
                return json.loads(text)
        return {"owner": None, "until": self._files.getFileStatus(self._at(f"claim-{token}")).getModificationTime() / 1000 + self.lease}

    def _write(self, until: float) -> None:
        out = self._files.create(self._at(f"lease-{self.token}"), True)
        try:
            out.write(bytearray(json.dumps({"owner": self.owner, "until": until}).encode()))
        finally:
            out.close()

    def claim(self) -> int:
        """Takes the lock if it is free, released, expired or this owner's own; the fencing token, or ``RunLocked``."""
        top = self._claims()
        if top:
            held = self._state(top)
            if held["until"] > self.clock() and held["owner"] != self.owner:
                raise RunLocked(f"{self.path}: held by {held['owner']} (claim {top})")
        if not self._files.createNewFile(self._at(f"claim-{top + 1}")):
            raise RunLocked(f"{self.path}: another writer made claim {top + 1}")
        self.token = top + 1
        self._write(self.clock() + self.lease)
        return self.token

    def check(self) -> None:
        if not self.token or self._claims() != self.token:
            raise RunFenced(f"{self.path}: claim {self.token} of {self.owner} was taken over")

    def renew(self) -> None:
        self.check()
        self._write(self.clock() + self.lease)

    def release(self) -> None:
        """Gives the lock back; nothing happens if it was taken over."""
        if self.token and self._claims() == self.token:
            self._write(0.0)
        self.token = 0

    def __enter__(self) -> RunLock:
        self.claim()
        return self

    def __exit__(self, *_) -> None:
        self.release()


def deal(cells: DataFrame, path: str, n_slices: int) -> None:
    """Writes a plan's cells once, by slice, so that a slice reads its own cells only."""
    number = F.pmod(F.xxhash64(*schemas.CELL), F.lit(n_slices)).alias("slice")
    cells.select("*", number).repartition("slice").write.mode("overwrite").partitionBy("slice").parquet(path)


def commit(spark: SparkSession, staging: str, target: str, lock: RunLock) -> None:
    """Makes a staged folder part of the log by one rename, if the lock still holds. A slice that is there already is not written again."""
    from_, to = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staging, target))
    found = from_.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        lock.renew()
    except RunFenced:
        found.delete(from_, True)
        raise
    if found.exists(to):
        found.delete(from_, True)
    else:
        found.mkdirs(to.getParent())
        if not found.rename(from_, to):
            raise OSError(f"{staging} could not be made {target}")


def generate_slices(
    spark: SparkSession, cells: DataFrame, run_dir: str, options: runs.RunOptions, lock: RunLock, *, n_slices: int, adapter: runs.Adapter = runs.echo_adapter, after_slice: Callable[[int], None] | None = None
) -> int:
    """Generates and commits the cells of a plan (``runs.plan_run``) slice by slice; how many slices were committed.

    ``after_slice`` is told each slice's number once it is committed; what it
    raises ends the run. Slices are committed under the lock's token, so those
    of different claims never meet.
    """
    plan, done = f"{run_dir}/_plans/{lock.token}", 0
    deal(cells, plan, n_slices)
    numbered = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in cells.schema)}, slice int").parquet(plan)
    for number in range(n_slices):
        part = numbered.filter(F.col("slice") == number).drop("slice").repartition(spark.sparkContext.defaultParallelism)
        if part.isEmpty():
            continue
        staging = f"{run_dir}/_staging/{lock.token}-{number}"
        runs.generate(part, options, adapter).write.mode("overwrite").json(staging)
        commit(spark, staging, f"{run_dir}/generations/slice-{lock.token:06d}-{number:06d}", lock)
        done += 1
        if after_slice:
            after_slice(number)
    return done
