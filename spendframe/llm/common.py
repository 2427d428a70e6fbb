"""What the corpus operators share: text rules, stored intermediate tables, row packing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space is U+0020 and U+0009 to U+000D; case folding covers A to Z.
WHITE_CHARS = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as spark.checkpoint.dir names it.

    A session in one local process may go without; then a temporary folder of that process is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spendframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Tables:
    """The intermediate tables that are stored while this is entered, to be removed together once nothing reads them."""

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> Tables:
        OPEN.append(self)
        return self

    def __exit__(self, *_) -> None:
        OPEN.remove(self)

    def remove(self, spark: SparkSession) -> None:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)


OPEN: list[Tables] = []


def stored(frame: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again.

    Cuts the lineage in a way that survives lost executors, gives later plans true sizes, and fixes
    values that another run of the same task could give otherwise, such as row numbers.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    for tables in OPEN:
        tables.paths.append(path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def packed(frame: DataFrame, columns: list[str] | None = None) -> Column:
    """The given columns (all, if none are given) as one struct, so that no name can clash with a working column."""
    names = frame.columns if columns is None else columns
    return F.struct(*[frame[f"`{name}`"] for name in names]) if names else F.struct(F.lit(0).alias("none"))


def unpacked(struct: str, columns: list[str], taken: set[str] | frozenset[str] = frozenset()) -> list[Column]:
    """The columns of a packed row; those in ``taken`` are left to the operator's own results."""
    return [F.col(f"{struct}.`{name}`").alias(name) for name in columns if name not in taken]
