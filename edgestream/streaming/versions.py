"""State of a stream as tables in a shared folder: each micro-batch reads the version before its own and writes its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """tables: schemas by name. A version is there once all of its tables are; the last two are kept.

    A batch that is run again reads what it read the first time and writes over what it wrote, so every batch
    counts exactly once.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, str]) -> None:
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), tables
        self.files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, below: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{below}".rstrip("/"))

    def done(self) -> list[int]:
        """Numbers of the versions that are there, ascending."""
        if not self.files.exists(self._at("")):
            return []
        names = [x.getPath().getName() for x in self.files.listStatus(self._at(""))]
        numbers = sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))
        return [v for v in numbers if all(self.files.exists(self._at(f"version={v}/{t}/_SUCCESS")) for t in self.tables)]

    def before(self, batch: int | None = None) -> dict[str, DataFrame]:
        """The tables of the last version before the batch (None: of the last one); empty ones at the beginning."""
        last = [v for v in self.done() if batch is None or v < batch]
        if not last:
            return {name: self.spark.createDataFrame([], schema) for name, schema in self.tables.items()}
        return {name: self.spark.read.schema(schema).parquet(f"{self.folder}/version={last[-1]}/{name}") for name, schema in self.tables.items()}

    def put(self, batch: int, **tables: DataFrame) -> None:
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/version={batch}/{name}")
        for v in self.done():
            if v < batch - 1:
                self.files.delete(self._at(f"version={v}"), True)
