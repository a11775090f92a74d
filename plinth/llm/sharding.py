"""Sharding by size-tiered compaction with a versioned manifest. DataFrame functions only.

A store is a folder of immutable runs (Parquet folders) and manifests. ``append`` adds arrivals as small runs. ``compact``
takes a tier (runs whose sizes are within one power of ``fanout``) that has ``fanout`` runs or more, merges it into one run of
files near ``target_bytes`` and repeats until no tier is full. Every change is a new manifest: it is written beside its place
and renamed to ``v<number>.json``, which fails if another writer took the number first; readers see whole versions only.
Old versions stay readable until ``vacuum`` deletes the runs that the newest manifest does not name. A writer that dies
leaves files that no manifest names.

The exclusive rename holds on HDFS and on local file systems. An object store whose rename copies has no such step: put the
``manifests`` folder on a file system that has it there, or let one writer commit at a time.

Merging reads and writes runs without a shuffle: splits of the old files are gathered into as many tasks as new files.

Defined cases: repeated rows stay repeated, nulls stay null, texts of any length stay whole; an empty arrival makes no run but
a version; rows whose arrival is null or out of range come with the last version, in runs of their own; an arrival may bring
columns that the store has not (rows from before have nulls there) or lack some, but not change a column's type; helper
names do not clash.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

FANOUT, TARGET_BYTES, BASE_BYTES = 4, 128 << 20, 1 << 20
_ARRIVAL = "__plinth_arrival"


@dataclass
class Run:
    name: str
    path: str
    bytes: int
    files: int
    arrivals: list[int]


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT, target_bytes: int = TARGET_BYTES):
        self.spark, self.root, self.fanout, self.target = spark, root.rstrip("/"), fanout, target_bytes
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Run], str | None]:
        """(version, runs, schema in JSON); version 0 is the empty store."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if version == 0:
            return 0, [], None
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:08d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return version, [Run(**r) for r in found["runs"]], found["schema"]

    def commit(self, version: int, runs: list[Run], schema: str | None) -> int:
        """Make ``version`` the newest; fails if it exists."""
        folder = f"{self.root}/manifests"
        self._fs.mkdirs(self._path(folder))
        draft, final = self._path(f"{folder}/.draft-{uuid.uuid4().hex}"), self._path(f"{folder}/v{version:08d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "runs": [asdict(r) for r in runs]}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    # writing

    def append(self, df: DataFrame, arrival: Column | None = None, arrivals: int = 1) -> int:
        """Add rows as runs, one for each value of ``arrival`` (0 .. arrivals - 1), in one job; one version for each arrival."""
        version, runs, schema = self.manifest()
        schema = _widened(schema, df.schema)
        name = uuid.uuid4().hex[:12]
        base = f"{self.root}/runs/{name}"
        df.withColumn(_ARRIVAL, arrival if arrival is not None else F.lit(0)).write.partitionBy(_ARRIVAL).parquet(base)
        wanted = {f"{_ARRIVAL}={k}" for k in range(arrivals)}
        there = [f.getPath() for f in self._fs.listStatus(self._path(base)) if f.getPath().getName().startswith(f"{_ARRIVAL}=")]
        late = sorted(p.getName() for p in there if p.getName() not in wanted)
        known = {p.getName(): p for p in there}
        for k in range(arrivals):
            for label in [f"{_ARRIVAL}={k}", *(late if k == arrivals - 1 else [])]:
                if label in known:
                    size = self._fs.getContentSummary(known[label])
                    runs = [*runs, Run(f"{name}-{label.partition('=')[2]}", known[label].toString(), size.getLength(), size.getFileCount(), [version + 1])]
            version = self.commit(version + 1, runs, schema)
        return version

    def tier(self, run: Run) -> int:
        return max(0, math.floor(math.log(max(run.bytes, 1) / BASE_BYTES, self.fanout))) if run.bytes > BASE_BYTES else 0

    def compact(self, vacuum: bool = False) -> int:
        """Merge full tiers until there is none; returns the newest version. With ``vacuum`` runs go as soon as they are merged,
        for stores that nobody reads meanwhile."""
        while True:
            version, runs, schema = self.manifest()
            tiers: dict[int, list[Run]] = {}
            for r in runs:
                tiers.setdefault(self.tier(r), []).append(r)
            full = sorted(t for t, own in tiers.items() if len(own) >= self.fanout)
            if not full:
                return version
            merged = tiers[full[0]][: self.fanout] if full[0] else tiers[0]
            total = sum(r.bytes for r in merged)
            name = uuid.uuid4().hex[:12]
            path = f"{self.root}/runs/{name}"
            self._read(merged, schema).coalesce(max(1, math.ceil(total / self.target))).write.parquet(path)
            size = self._fs.getContentSummary(self._path(path))
            rest = [r for r in runs if r not in merged]
            new = Run(name, path, size.getLength(), size.getFileCount(), sorted(a for r in merged for a in r.arrivals))
            self.commit(version + 1, [*rest, new], schema)
            if vacuum:
                self._delete(merged)

    def _delete(self, runs: list[Run]) -> None:
        for r in runs:
            self._fs.delete(self._path(r.path), True)

    def vacuum(self) -> int:
        """Delete the runs of older versions that the newest does not name; returns their number."""
        version, runs, _ = self.manifest()
        kept, gone = {r.path for r in runs}, {}
        for v in self.versions():
            if v < version:
                gone |= {r.path: r for r in self.manifest(v)[1] if r.path not in kept}
        self._delete([r for r in gone.values() if self._fs.exists(self._path(r.path))])
        return len(gone)

    # reading

    def _read(self, runs: list[Run], schema: str | None) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema)) if schema else StructType([])
        if not runs:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[r.path for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (by default the newest); of versions before a vacuum only those whose runs are left."""
        _, runs, schema = self.manifest(version)
        return self._read(runs, schema)


def _widened(schema: str | None, new: StructType) -> str:
    """The store's schema with the columns that a new arrival adds."""
    fields = {f.name: f for f in StructType.fromJson(json.loads(schema))} if schema else {}
    for f in new:
        if f.name in fields and fields[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()} in the store, not {f.dataType.simpleString()}")
        fields.setdefault(f.name, StructField(f.name, f.dataType, True))
    return StructType(list(fields.values())).json()
