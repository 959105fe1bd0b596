"""Tables to which rows are added once for each key, by several writers at a time.

A table is a folder of written parts and of commits, numbered without a gap; a commit is a
small file that names its part. A writer stages the rows whose keys no commit has yet, as
a part that nobody reads, and then claims the next number. A number is claimed once: the
file is put in place by an operation that fails where there is one already. Who comes
late looks again at what was added meanwhile, and stages what is then left. Parts of
commits are never written again, so existing rows stay byte for byte what they are; a
writer that dies leaves a part that no commit names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)
        self._fs.mkdirs(self._at("/commits"))

    def _at(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path + below)

    def commits(self) -> list[str]:
        """The parts in the order of their commits."""
        found = self._fs.listStatus(self._at("/commits"))
        # a commit's name is its number and its part
        names = sorted(f.getPath().getName() for f in found if f.getPath().getName().endswith(".commit"))
        out = []
        for name in names:
            stream = self._fs.open(self._at(f"/commits/{name}"))
            try:
                out.append(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return out

    def rows(self, parts: list[str] | None = None) -> DataFrame:
        parts = self.commits() if parts is None else parts
        read = self.spark.read.schema(self.schema)
        return read.parquet(*(f"{self.path}/parts/{p}" for p in parts)) if parts else self.spark.createDataFrame([], self.schema)

    def _claim(self, number: int, part: str) -> bool:
        """Put the commit in place unless its number is taken."""
        staged, place = self._at(f"/commits/.{part}"), self._at(f"/commits/{number:010d}.commit")
        out = self._fs.create(staged, True)
        out.write(part.encode())
        out.close()
        if self._fs.getUri().getScheme() == "file":
            # a local rename would replace the file; a link does not
            to_path = lambda p: self._jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0))
            try:
                self._jvm.java.nio.file.Files.createLink(to_path(place), to_path(staged))
                return True
            except Exception as e:
                if "FileAlreadyExists" not in str(e):
                    raise
                return False
            finally:
                self._fs.delete(staged, False)
        if self._fs.exists(place) or not self._fs.rename(staged, place):
            self._fs.delete(staged, False)
            return False
        return True

    def insert_if_absent(self, new: DataFrame) -> int:
        """Add the rows whose key is not there, one for each key, and say how many were added; rows that are there stay."""
        names = self.rows([]).columns
        left, seen = new.select(*names).dropDuplicates(self.keys), []
        while True:
            parts = self.commits()
            later = self.rows([p for p in parts if p not in seen])
            # keys are equal if both are null as well
            on = [left[k].eqNullSafe(later[k]) for k in self.keys]
            part = uuid.uuid4().hex
            left.join(later, on, "left_anti").write.parquet(f"{self.path}/parts/{part}")
            left, seen = self.rows([part]), parts
            n = left.count()
            if not n:
                return 0
            if self._claim(len(parts), part):
                return n
