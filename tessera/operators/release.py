"""Release of a set of artifacts: inventory, preflight, and a promotion that readers can trust.

A release is written beside the current one and published by one small pointer file. While that
happens a marker stands in the data folder and readers refuse (they fail closed); the marker
stays if anything fails.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import RELEASE_MARKER


def inventory(entities: DataFrame, entity: str, kinds: list[str], found: DataFrame) -> DataFrame:
    """Every entity with every kind of artifact, and whether it is there: found has (entity, kind, sha256)."""
    wanted = entities.select(entity).distinct().select(entity, F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    return wanted.join(found.select(entity, "kind", "sha256"), [entity, "kind"], "left").withColumn("present", F.col("sha256").isNotNull())


def preflight(items: DataFrame, gates: dict[str, bool]) -> list[str]:
    """Reasons not to release: artifacts that are missing, and gates that are closed."""
    missing = items.filter("NOT present").count()
    return ([f"{missing} artifacts are missing"] if missing else []) + [name for name, ok in gates.items() if not ok]


class Store:
    """Small files of a folder, by the file system that Spark uses for it."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(folder).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        self._over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        self._copy, self._conf, self.folder = jvm.org.apache.hadoop.fs.FileUtil.copy, conf, folder

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}"))

    def write(self, name: str, text: str, overwrite: bool = True) -> None:
        """Written under another name and renamed over the old file in one step: a reader sees the old or the new one, whole."""
        if not overwrite and self.exists(name):
            raise FileExistsError(f"{self.folder}/{name}")
        part = self._path(f"{self.folder}/.{name}.part")
        out = self._fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        self._context.rename(part, self._path(f"{self.folder}/{name}"), self._over)

    def copy(self, source: str, name: str) -> None:
        """A file copied into the folder, seen only when it is whole."""
        part = self._path(f"{self.folder}/.{name}.part")
        self._copy(self._path(source).getFileSystem(self._conf), self._path(source), self._fs, part, False, True, self._conf)
        self._context.rename(part, self._path(f"{self.folder}/{name}"), self._over)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)

    def next_version(self) -> int:
        """One more than the highest folder v1, v2, ... there is."""
        root = self._path(self.folder)
        names = [f.getPath().getName() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return max([int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()], default=0) + 1


def promote(spark: SparkSession, folder: str, tables: dict[str, DataFrame], release_id: str, problems: list[str]) -> str:
    """Writes the tables as the next version and points readers to it; returns the version's folder."""
    if problems:
        raise ValueError("; ".join(problems))
    store = Store(spark, folder)
    version = f"v{store.next_version()}"
    store.write(RELEASE_MARKER, release_id)
    if store.exists("current.json"):  # what readers are pointed to now, to go back to
        store.copy(f"{folder}/current.json", "previous.json")
    rows, digests = {}, {}
    for name, df in tables.items():
        path = f"{folder}/{version}/{name}.parquet"
        df.write.mode("errorifexists").parquet(path)
        wanted, written = (content(x) for x in (df, spark.read.parquet(path)))
        if wanted != written:
            raise OSError(f"{path} does not hold what was to be written: {written} for {wanted}")
        rows[name], digests[name] = written
    store.write("current.json", json.dumps({"release_id": release_id, "version": version, "rows": rows, "digests": digests}, sort_keys=True))
    store.delete(RELEASE_MARKER)
    return f"{folder}/{version}"


def content(df: DataFrame) -> tuple[int, str]:
    """Rows, and a digest of them in any order: the sum of the rows' hashes, so that equal rows do not cancel."""
    row = F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(df.columns)]).cast("decimal(38,0)")
    found = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row), F.lit(0)).cast("string")).first()
    return found[0], found[1]


def roll_back(spark: SparkSession, folder: str) -> dict:
    """Points readers to the release before the current one and clears the marker of a failed release."""
    store = Store(spark, folder)
    store.copy(f"{folder}/previous.json", "current.json")
    store.delete(RELEASE_MARKER)
    return json.loads(store.read("current.json"))


def current(spark: SparkSession, folder: str) -> dict:
    """What the pointer names; refuses while a release is in progress."""
    store = Store(spark, folder)
    if store.exists(RELEASE_MARKER):
        raise RuntimeError(f"a release is being written to {folder}")
    return json.loads(store.read("current.json"))
