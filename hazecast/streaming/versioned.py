"""A table of micro-batches that stays small: runs, merges and a manifest.

Every batch is written as a run, a folder of its own.  A manifest, a small file
per version written once and whole, names the live runs; the newest manifest is
the table, so a reader sees all of a commit or nothing of it.  Runs are merged
like those of a log-structured tree: while the newest run has at least half the
rows of the one before, the two become one.  Each live run then has over twice
the rows of the next, so there are at most log2(rows) of them and reading
touches at most twice the rows of the merged table, however many batches came.

A batch number is committed once: replayed batches are ignored, whether their
run is still alone or merged.  A merge that is killed leaves a folder that no
manifest names; the runs it was made of stay live.  Runs that the newest
manifests no longer name are removed by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hazecast.session import SharedFolder


class VersionedTable:
    """``merge`` turns the union of runs into one row per key; it must give the
    same for runs merged in any order and grouping."""

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.folder, self.merge = spark, SharedFolder(spark, path), merge

    def manifest(self) -> dict:
        """{version, batch: newest committed batch, runs: [{name, rows}]}."""
        names = self.folder.names("manifest")
        return json.loads(self.folder.read(f"manifest/{names[-1]}")) if names else {"version": 0, "batch": None, "runs": []}

    def _publish(self, batch, runs: list[dict], version: int) -> None:
        told = json.dumps({"version": version, "batch": batch, "runs": runs})
        if not self.folder.write_once(f"manifest/{version:012d}", told):
            raise RuntimeError(f"version {version} of {self.folder.path} has been written by another")

    def _write(self, df: DataFrame) -> dict:
        name = f"run-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder.path}/{name}")
        return {"name": name, "rows": self.spark.read.parquet(f"{self.folder.path}/{name}").count()}

    def commit(self, rows: DataFrame, batch: int) -> bool:
        """Add a batch; false if it, or a later one, is in the table already."""
        now = self.manifest()
        if now["batch"] is not None and batch <= now["batch"]:
            return False
        run = self._write(self.merge(rows))
        self._publish(batch, [*now["runs"], run], now["version"] + 1)
        self.compact()
        return True

    def compact(self) -> None:
        """Merge runs until each has over twice the rows of the next."""
        while True:
            now = self.manifest()
            k = merge_from([r["rows"] for r in now["runs"]])
            if k is None:
                return
            old = now["runs"][k:]
            new = self._write(self.merge(self._union(old)))
            self._publish(now["batch"], [*now["runs"][:k], new], now["version"] + 1)

    def _union(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.folder.path}/{r['name']}" for r in runs))

    def read(self) -> DataFrame | None:
        """The table; None while nothing has been committed."""
        runs = self.manifest()["runs"]
        return self.merge(self._union(runs)) if runs else None

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove runs and manifests that the ``keep`` newest manifests do not
        need; returns the runs removed."""
        names = self.folder.names("manifest")
        live = {r["name"] for n in names[-keep:] for r in json.loads(self.folder.read(f"manifest/{n}"))["runs"]}
        gone = [n for n in self.folder.names("") if n.startswith("run-") and n not in live]
        for n in [*gone, *(f"manifest/{n}" for n in names[:-keep])]:
            self.folder.remove(n)
        return gone


def merge_from(rows: list[int]) -> int | None:
    """From which run on the newest runs are to be merged; None: they are not."""
    k, total = len(rows) - 1, rows[-1] if rows else 0
    while k > 0 and 2 * total >= rows[k - 1]:
        k -= 1
        total += rows[k]
    return k if k < len(rows) - 1 else None
