"""Graph snapshots: versioned Parquet folders partitioned by project, switched by numbered pointer files.

Pointers and leases are written with *create, never overwrite*: of two writers of the same number one fails and tries
again on top of the other, readers take the greatest number that is complete, and nothing is ever deleted before its
successor can be read.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LEASE_SECONDS = 120


class GraphStore:
    """Tables below ``root``; a commit writes new folders and then a new pointer, so readers see whole versions only."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        folder = self._path(f"{self.root}/{name}")
        if not self._fs.exists(folder):
            return []
        found = [str(x.getPath().getName()) for x in self._fs.listStatus(folder)]
        return sorted((int(x[:-5]) for x in found if x.endswith(".json") and x[:-5].isdigit()), reverse=True)

    def _latest(self, name: str) -> tuple[int, dict]:
        """(number, value) of the newest complete file of ``name``; (0, {}) if there is none."""
        for n in self._numbers(name):
            stream = self._fs.open(self._path(f"{self.root}/{name}/{n:012d}.json"))
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return n, json.loads(text)
            except ValueError:  # its writer is still at it, or was lost
                continue
        return 0, {}

    def _put(self, name: str, value: dict, after: int) -> bool:
        """Write ``value`` as the successor of number ``after``; false if somebody else has written a later one."""
        newest = max(self._numbers(name), default=0)
        if newest > after and self._latest(name)[0] > after:
            return False
        try:
            out = self._fs.create(self._path(f"{self.root}/{name}/{max(newest, after) + 1:012d}.json"), False)
        except Py4JJavaError:  # the file exists
            return False
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        return True

    def tables(self) -> dict[str, dict]:
        return self._latest("current")[1]

    def load(self, name: str) -> DataFrame | None:
        at = self.tables().get(name)
        if at is None:
            return None
        schema = StructType.fromJson(at["schema"])  # kept with the pointer, so that empty tables can be read too
        return self.spark.read.schema(schema).parquet(f"{self.root}/{at['folder']}")

    def commit(self, **tables: DataFrame) -> None:
        """Write the given tables as a new version; tables not given stay as they are when the version is published.

        Rows are clustered by project; a project too large for one task is split (rebalanced by size at run time).
        """
        version, new = uuid.uuid4().hex, {}
        for name, df in tables.items():
            folder = f"{name}-{version}"
            w = df.hint("rebalance", "project").write.partitionBy("project") if "project" in df.columns else df.write
            w.parquet(f"{self.root}/{folder}")
            new[name] = {"folder": folder, "schema": json.loads(df.schema.json())}
        while True:
            number, now = self._latest("current")
            if self._put("current", now | new, number):
                return

    def drop_project(self, project: str) -> None:
        self.commit(**{n: self.load(n).where(F.col("project") != project) for n in self.tables()})

    @staticmethod
    def _lease(project: str) -> str:
        return "leases/" + hashlib.sha256(project.encode()).hexdigest()[:32]

    def acquire(self, project: str, holder: str) -> bool:
        """Take or renew the lease of one writer per project; false while another holder's lease lasts."""
        number, held = self._latest(self._lease(project))
        if held and held["holder"] != holder and held["expires"] > time.time():
            return False
        return self._put(self._lease(project), {"holder": holder, "expires": time.time() + LEASE_SECONDS}, number)

    def release(self, project: str, holder: str) -> None:
        number, held = self._latest(self._lease(project))
        if held.get("holder") == holder:
            self._put(self._lease(project), {"holder": holder, "expires": 0}, number)

    def acquire_within(self, project: str, holder: str, seconds: float, poll: float = 0.5) -> bool:
        """``acquire``, tried again every ``poll`` seconds for at most ``seconds``."""
        end = time.time() + seconds
        while not self.acquire(project, holder):
            if time.time() + poll > end:
                return False
            time.sleep(poll)
        return True
