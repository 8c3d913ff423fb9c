"""Writers: staged, then moved into place, a manifest last; nothing is ever overwritten."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class OutputExists(FileExistsError):
    """A target of the run is already there."""


class Session:
    """One run's outputs below a folder.  Each part is written to a staging folder on the same file system;
    ``commit`` moves the parts into place and writes the manifest last, so a reader that sees a
    manifest sees everything it names.  ``abort`` (or an exception inside ``with``) leaves nothing."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.staging = f"{self.folder}/_staging-{uuid.uuid4().hex}"
        self.parts: dict[str, dict] = {}

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def text(self, name: str, rows: DataFrame, column: str, order: list[str], compression: str = "gzip", header: str = "", lines: int = 1) -> None:
        """Records of ``lines`` lines in ``column``, ordered over all files; ``header`` becomes a file that sorts before them.

        Counts and digests are of the files as written.
        """
        # Range partitions keep the order across files without one task seeing all rows.
        ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(column).alias("value"))
        ordered.write.option("compression", compression).text(f"{self.staging}/{name}")
        written = self.spark.read.text(f"{self.staging}/{name}").agg(F.count("*").alias("n"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("s")).first()
        if written["n"] % lines:
            raise OSError(f"{name} was written with {written['n']} lines")
        if header:
            self.spark.createDataFrame([(header,)], "value string").coalesce(1).write.text(f"{self.staging}/{name}/header")
        self.parts[name] = {"kind": "text", "rows": written["n"] // lines, "sum": str(written["s"]), "files": self._files(name)}

    def _files(self, name: str) -> dict:
        """How many files a part has, their bytes, and the SHA-256 over their digests in the order of their names."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{self.staging}/{name}")
        rows = found.select(F.regexp_extract("path", r"/([^/]+/[^/]+)$", 1).alias("path"), "length", F.sha2("content", 256).alias("d")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.sort_array(F.collect_list(F.struct("path", "d"))).alias("l"))
        row = rows.select("n", "bytes", F.sha2(F.array_join(F.col("l.d"), ""), 256).alias("digest")).first()
        return {"count": row["n"], "bytes": row["bytes"], "sha256": row["digest"]}

    def parquet(self, name: str, rows: DataFrame, by: str | None = None) -> None:
        writer = rows.write.partitionBy(by) if by else rows.write
        writer.parquet(f"{self.staging}/{name}")
        self.parts[name] = {"kind": "parquet", "rows": self.spark.read.parquet(f"{self.staging}/{name}").count(), "files": self._files(name)}

    def commit(self, facts: dict) -> dict:
        fs = self._fs()
        for name in [*self.parts, "manifest"]:
            if fs.exists(self._path(f"{self.folder}/{name}")):
                self.abort()
                raise OutputExists(f"{self.folder}/{name}")
        for name in self.parts:
            if not fs.rename(self._path(f"{self.staging}/{name}"), self._path(f"{self.folder}/{name}")):
                self.abort()
                raise OSError(f"{name} could not be moved into place")
        manifest = facts | {"outputs": self.parts}
        self.spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{self.folder}/manifest")
        self.abort()
        return manifest

    def abort(self) -> None:
        self._fs().delete(self._path(self.staging), True)

    def __enter__(self) -> Session:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.abort()


def sam_header(contigs: list[tuple[str, int]], run_id: str, program: str) -> str:
    """Header lines of an unsorted alignment file."""
    lines = ["@HD\tVN:1.6\tSO:unsorted"] + [f"@SQ\tSN:{name}\tLN:{length}" for name, length in contigs]
    return "\n".join([*lines, f"@RG\tID:{run_id}\tSM:{run_id}", f"@PG\tID:{program}\tPN:{program}"])


def bed_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Tab-separated lines of the given columns, in their order."""
    return rows.withColumn("line", F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns]))
