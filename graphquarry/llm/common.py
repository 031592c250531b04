"""What the operators share: words, shared working folders, joins that survive hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space between words, [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_or_empty(col: str | Column = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text, in order; an empty array if there are none."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_RUN))


def word_count(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, WHITE_RUN))).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z only. lower() also folds other letters, so it serves only where all bytes are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def quoted(name: str) -> str:
    """A column's name as F.col takes it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir, as a full URI.

    Where that is unset, a local master gets a temporary folder; a cluster gets an error, since
    a machine-local folder would lose files there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            _OWN[app] = tempfile.mkdtemp(prefix="graphquarry-")
        root = "file://" + _OWN[app]
    # A path without a scheme is one of the cluster's default file system, which Python's readers must be told.
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def deal(table: DataFrame) -> DataFrame:
    """A table as read, dealt over all cores if Spark would read it in fewer tasks than there are cores.

    Such a table has at most that many scan tasks' worth of bytes, so the shuffle is bounded by
    cores times spark.sql.files.maxPartitionBytes (a row group is never split), whatever files it comes in.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(path: str) -> None:
    """Deletes an intermediate folder that nothing reads any more."""
    fs, at = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(at).type == pafs.FileType.Directory:
        fs.delete_dir(at)


def release(*tables: DataFrame) -> None:
    """Deletes the files of materialised tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_folder(folder)


def hash_unit(col: str) -> Column:
    """An even hash of a column in [0, 1): rows below p are a sample of share p, the same in every run."""
    return F.pmod(F.xxhash64(col), F.lit(1 << 30)) / F.lit(float(1 << 30))


HOT_SHARE = 1000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """left join right on keys that are unique in right, where one key may hold much of left.

    right[weight] is the key's number of rows in left and total their sum, so at most HOT_SHARE keys
    reach total / HOT_SHARE: that bound lets them be broadcast, and no other key is large. Null keys match nulls.
    how: left, or inner.
    """
    bar = max(2, total // HOT_SHARE)
    out = [c for c in right.columns if c not in on and c != weight]
    value = F.struct(*[F.col(c) for c in out], F.lit(1).alias("_hit"))
    hot = right.where(F.col(weight) >= bar).select(*[F.col(c).alias(f"_h_{c}") for c in on], value.alias("_hot"))
    cold = right.where(F.col(weight) < bar).select(*[F.col(c).alias(f"_c_{c}") for c in on], value.alias("_cold"))
    same = lambda p: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{p}{c}")) for c in on])
    step = left.join(F.broadcast(hot), same("_h_"), "left")
    # A row that has found its hot key takes no part in the shuffled join.
    parts = [
        step.where(F.col("_hot").isNotNull()).withColumn("_got", F.col("_hot")),
        step.where(F.col("_hot").isNull()).join(cold, same("_c_"), how).withColumn("_got", F.col("_cold")),
    ]
    got = [p.select(*[F.col(c) for c in left.columns], *[F.col(f"_got.{c}").alias(c) for c in out]) for p in parts]
    return got[0].unionByName(got[1])


def null_safe_key(col: Column) -> Column:
    """A string key under which nulls meet nulls and nothing else."""
    return F.coalesce(F.concat(F.lit("v"), col.cast("string")), F.lit("n"))
