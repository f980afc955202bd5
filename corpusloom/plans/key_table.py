"""Keys of all batches of an index, so that a batch meets what is stored without reading it all.

A log-structured table. Each batch adds a run of its keys, dealt into folders by a hash of the key and sorted inside.
A lookup opens the folders that its keys hash to, in every live run. When `FANIN` runs of one size are committed
they are merged into one, so that a table of n batches has about FANIN * log(n) runs and a key is rewritten log(n) times.

A run's folder names its first and last batch. It counts when it is finished and its last batch is committed; where runs
overlap the longer one counts. Runs that a merge has replaced are deleted by the merge after it, as a reader may still
have them open.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import STORED, delete_path, matching_paths

BUCKETS = 16  # of an index that is not told otherwise; the folder's name keeps it
FANIN = 8
_RUN = re.compile(r"/run=(\d+)-(\d+)/_SUCCESS\Z")


@dataclass(frozen=True)
class KeyTable:
    """The keys below an index folder; `ddl` begins with the key's column."""

    spark: SparkSession
    home: str
    name: str
    ddl: str
    buckets: int = BUCKETS

    @property
    def key(self) -> str:
        return self.ddl.split(" ", 1)[0]

    @property
    def folder(self) -> str:
        return f"{self.home}/{self.name}-{self.buckets}"

    def _run(self, first: int, last: int) -> str:
        return f"{self.folder}/run={first:08d}-{last:08d}"

    def _finished(self) -> list[tuple[int, int]]:
        found = (_RUN.search(path) for path in matching_paths(self.spark, f"{self.folder}/run=*/_SUCCESS"))
        return sorted((int(m[1]), int(m[2])) for m in found if m)

    def live(self, committed: list[int]) -> list[tuple[int, int]] | None:
        """The runs that hold the keys of exactly the committed batches, or None if some have no keys here."""
        if not committed:
            return []
        longest: dict[int, int] = {}
        for first, last in self._finished():
            if last <= committed[-1]:
                longest[first] = max(last, longest.get(first, -1))
        cover, at = [], committed[0]
        while at <= committed[-1]:
            if at not in longest:
                return None
            cover.append((at, longest[at]))
            at = longest[at] + 1
        return cover

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        dealt = rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", self.key)
        writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", STORED)
        writer.partitionBy("bucket").parquet(self._run(first, last))

    def put(self, rows: DataFrame, batch: int) -> None:
        """The keys of a batch that is not committed yet, over what an earlier attempt left."""
        self._write(rows, batch, batch)

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], f"{self.ddl}, bucket INT")
        reader = self.spark.read.schema(f"{self.ddl}, run STRING, bucket INT").option("basePath", self.folder)
        return reader.parquet(*[self._run(*r) for r in runs]).drop("run")

    def all(self, committed: list[int]) -> DataFrame | None:
        """Every key of the committed batches; None if some have no keys here."""
        runs = self.live(committed)
        return None if runs is None else self._read(runs).drop("bucket")

    def lookup(self, keys: DataFrame, committed: list[int]) -> DataFrame | None:
        """The rows in the folders that `keys` (a stored table with the key's column) can be in."""
        runs = self.live(committed)
        if not runs:
            return None if runs is None else self._read([]).drop("bucket")
        touched = sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())  # no more than there are buckets
        rows = self._read(runs)
        return (rows.filter(F.col("bucket").isin(touched)) if len(touched) < self.buckets else rows).drop("bucket")

    def compact(self, committed: list[int]) -> list[tuple[int, int]]:
        """Merge what the last commit has made due; returns the runs that were written."""
        finished, made = self._finished(), []
        size = FANIN
        while committed and (committed[-1] + 1) % size == 0:
            first, last = committed[-1] + 1 - size, committed[-1]
            parts = [r for r in self.live(committed) or [] if first <= r[0] and r[1] <= last]
            if len(parts) > 1 and parts[0][0] == first:
                if not made:
                    self._collect(finished)
                self._write(self._read(parts).drop("bucket"), first, last)
                made.append((first, last))
            size *= FANIN
        return made

    def _collect(self, finished: list[tuple[int, int]]) -> None:
        for first, last in finished:
            if any(a <= first and last <= b and (a, b) != (first, last) for a, b in finished):
                delete_path(self.spark, self._run(first, last))
