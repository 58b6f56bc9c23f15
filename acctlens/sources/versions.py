"""Tables of versions: a refresh that readers survive, and readers that stay with the version they began with.

A version is a folder that is written whole and never changed. A manifest is a small file that names the
version; it is put in place under its final, numbered name by one rename that fails if that name is
taken, so of two writers one loses and nothing is half visible. The newest manifest is the table. A writer that ends before
its rename leaves a folder that no manifest names. :func:`vacuum` deletes such folders and old
versions, later than their readers need them.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T

MANIFESTS = "_manifests"


class CommitConflict(RuntimeError):
    """Another writer has committed since the version that this one began with."""


class Files:
    """The few operations on a shared folder that Spark's own file systems give."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder.rstrip("/")
        self.system = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> JavaObject:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str = "") -> list[str]:
        if not self.system.exists(self.path(name)):
            return []
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.path(name)))

    def modified(self, name: str) -> float:
        """Seconds since 1970 of the newest change of a file, or of a folder and what lies in it."""
        path = self.path(name)
        return max(s.getModificationTime() for s in [self.system.getFileStatus(path), *self.system.listStatus(path)]) / 1000

    def size(self, name: str) -> int:
        """Bytes of a file or of all that lies in a folder; none where there is nothing."""
        path = self.path(name)
        return self.system.getContentSummary(path).getLength() if self.system.exists(path) else 0

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Put a whole file under a name that is not taken; False, and nothing done, if it is."""
        draft = self.path(f"{name.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
        stream = self.system.create(draft)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        # A rename onto a file that exists fails; some systems say so by False, some by an exception.
        try:
            if not self.system.exists(self.path(name)) and self.system.rename(draft, self.path(name)):
                return True
        except Exception:
            if not self.system.exists(self.path(name)):
                raise
        self.system.delete(draft, False)
        return False

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)


@dataclass(frozen=True)
class Version:
    """What a manifest says: the folders that make up the table, and notes of the writer."""

    number: int
    folders: tuple[str, ...] = ()
    schema: T.StructType | None = None
    notes: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"folders": self.folders, "schema": self.schema.jsonValue() if self.schema else None, "notes": self.notes})


@dataclass(frozen=True)
class VersionedTable:
    """A table of immutable folders and numbered manifests in one shared folder."""

    folder: str

    def numbers(self, spark: SparkSession) -> list[int]:
        """Committed versions, oldest first."""
        return [int(n) for n in Files(spark, self.folder).names(MANIFESTS) if n.isdigit()]

    def version(self, spark: SparkSession, number: int | None = None) -> Version:
        """A committed version, the newest if no number is given; number 0 stands for no version yet."""
        files = Files(spark, self.folder)
        if number is None:
            number = max(self.numbers(spark), default=0)
        if number == 0:
            return Version(0)
        said = json.loads(files.read(f"{MANIFESTS}/{number:012d}"))
        schema = T.StructType.fromJson(said["schema"]) if said["schema"] else None
        return Version(number, tuple(said["folders"]), schema, said["notes"])

    def read(self, spark: SparkSession, number: int | None = None) -> DataFrame:
        """The table as of a version. The frame keeps to that version's files whatever is committed later."""
        version = self.version(spark, number)
        if not version.number:
            raise AnalysisException(f"no version of {self.folder} has been committed")
        return self.frame(spark, version)

    def frame(self, spark: SparkSession, version: Version) -> DataFrame:
        if not version.folders:
            return spark.createDataFrame([], version.schema)
        return spark.read.schema(version.schema).parquet(*[f"{self.folder}/{f}" for f in version.folders])

    def stage(self, df: DataFrame, *parts: str) -> str:
        """Write a frame as a new folder that no reader sees yet, with a folder inside for each value of ``parts``."""
        name = f"data-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").partitionBy(*parts).parquet(f"{self.folder}/{name}")
        return name

    def commit(self, spark: SparkSession, base: Version, folders: list[str], schema: T.StructType, notes: dict | None = None) -> Version:
        """Make the folders the version after ``base``; :class:`CommitConflict` if that number is taken."""
        version = Version(base.number + 1, tuple(folders), schema, notes or {})
        if not Files(spark, self.folder).write_new(f"{MANIFESTS}/{version.number:012d}", version.text()):
            raise CommitConflict(f"version {version.number} of {self.folder} has been committed by another writer")
        return version

    def overwrite(self, df: DataFrame, notes: dict | None = None) -> Version:
        """Replace the table and its schema. ``df`` may read the table itself."""
        spark = df.sparkSession
        base = self.version(spark)
        return self.commit(spark, base, [self.stage(df)], df.schema, notes)

    def vacuum(self, spark: SparkSession, keep: int = 2, older_than: float = 86_400.0) -> list[str]:
        """Delete old manifests and the folders that no kept version names, if they are older than so
        many seconds: readers pin versions, and writers stage folders, for less than that.

        Gives the names of the deleted folders.
        """
        files = Files(spark, self.folder)
        numbers = self.numbers(spark)
        kept = numbers[-max(keep, 1):]
        # A version may name a part of a folder, which then stays as a whole.
        named = {f.split("/")[0] for n in kept for f in self.version(spark, n).folders}
        late = time.time() - older_than
        for n in numbers:
            if n not in kept:
                files.delete(f"{MANIFESTS}/{n:012d}")
        gone = [f for f in files.names() if f.startswith("data-") and f not in named and files.modified(f) <= late]
        for f in gone:
            files.delete(f)
        return gone
