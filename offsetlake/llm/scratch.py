"""Tables in the folder that driver and executors share (``spark.checkpoint.dir``), so that lost executors cost a re-read only."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local master may leave it unset, and gets a temporary folder of this process.

    On a cluster a temporary folder would be another one on each machine, so an unset folder is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="offsetlake-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def materialise(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/offsetlake/{uuid.uuid4().hex}/{tag}"
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that `materialise` wrote and that nothing reads any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.scratch_path.rsplit("/", 1)[0])
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def corpus_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts: one scan and one aggregated row."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0)).alias("b")).first()["b"])


def fresh(name: str, taken: list[str]) -> str:
    """A column name like `name` that no column has, whatever the case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
