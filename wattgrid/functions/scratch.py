"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without it a local folder is made in local mode (tests); on a cluster executors share none, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-wattgrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Writes intermediate results of one operator as Parquet and reads them back.

    A written table survives the loss of any executor, and iterative work over it has a plan of constant size.
    ``drop`` deletes tables that nothing will read again; the rest stay until the owner of the folder clears it,
    because the result that an operator returns is lazy and may still read them. Who has written such a result elsewhere
    can delete them: ``collected`` gives all that were opened inside it.
    """

    _collectors: list[list[Scratch]] = []

    @classmethod
    @contextmanager
    def collected(cls) -> Iterator[list[Scratch]]:
        made: list[Scratch] = []
        cls._collectors.append(made)
        try:
            yield made
        finally:
            cls._collectors.remove(made)

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.cuts = 0
        self.live: set[str] = set()
        for made in self._collectors:
            made.append(self)

    def cut(self, df: DataFrame, files: int | None = None) -> DataFrame:
        """df, computed once and read back; files: upper bound of files where the result is small."""
        path, self.cuts = f"{self.root}/{self.cuts}", self.cuts + 1
        (df if files is None else df.coalesce(files)).write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        self.live.add(path)
        return back

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of finished steps now: it does so when the driver's JVM collects garbage, for which PySpark has no call of its own."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        self._delete({df._scratch_path for df in tables})

    def keep_only(self, *tables: DataFrame) -> None:
        """Deletes all tables written so far but the given ones, which the result still reads."""
        self._delete(self.live - {df._scratch_path for df in tables})

    def _delete(self, paths: set[str]) -> None:
        for name in paths & self.live:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.live -= paths
