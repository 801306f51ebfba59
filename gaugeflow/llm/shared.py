"""Folders that all executors share, for tables written between steps, and commits in them."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _configured(spark: SparkSession) -> str | None:
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()


def _on(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def workdir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which goes when the driver ends. Where
    that is unset, a local session (tests) gets a temporary folder, and a cluster an error:
    its executors could not read each other's files."""
    root = _configured(spark)
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gaugeflow-")
        spark.sparkContext.setCheckpointDir(root)
        fs, p = _on(spark, root)
        fs.deleteOnExit(p)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, p = _on(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def settle(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it again: cuts the lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, longer by underscores where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _on(spark, path)
    fs.delete(p, True)


class CommitLog:
    """Numbered commits of a folder, each a small JSON file that only one writer can create.

    A batch writes its tables to a folder of its own attempt and names that in its commit,
    so that what a failed or overtaken attempt leaves is never read. Creation is atomic
    where the file system can link (local) or rename without replacing (HDFS); on a store
    that can't, a single writer at a time is needed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/commits"

    def _local(self) -> str | None:
        head, _, rest = self.path.partition(":")
        if not rest:
            default = _on(self.spark, self.path)[0].getScheme()
            return self.path if default == "file" else None
        return "/" + rest.lstrip("/") if head == "file" else None

    def _names(self) -> list[str]:
        fs, p = _on(self.spark, self.path)
        if not fs.exists(p):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.isdigit())

    def _read(self, name: str) -> dict:
        if (local := self._local()) is not None:
            with open(f"{local}/{name}", encoding="utf-8") as f:
                return json.load(f)
        fs, p = _on(self.spark, f"{self.path}/{name}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def entries(self) -> list[dict]:
        """The commits in order, from the last one with ``base`` on, which sums up all
        before it; each with its ``number``."""
        out: list[dict] = []
        for name in reversed(self._names()):
            out.append(self._read(name) | {"number": int(name)})
            if out[-1].get("base"):
                break
        return out[::-1]

    def append(self, number: int, entry: dict) -> bool:
        """Commit ``entry`` as ``number``; False if another writer has taken that number."""
        name, content = f"{number:012d}", json.dumps(entry)
        spare = f".{name}-{uuid.uuid4().hex}"
        if (local := self._local()) is not None:
            os.makedirs(local, exist_ok=True)
            with open(f"{local}/{spare}", "w", encoding="utf-8") as f:
                f.write(content)
            try:
                os.link(f"{local}/{spare}", f"{local}/{name}")
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{local}/{spare}")
            return True
        fs, p = _on(self.spark, f"{self.path}/{spare}")
        out = fs.create(p, True)
        out.write(bytearray(content.encode()))
        out.close()
        final = _on(self.spark, f"{self.path}/{name}")[1]
        done = not fs.exists(final) and fs.rename(p, final)
        if not done:
            fs.delete(p, False)
        return bool(done)
