"""Session helpers shared by operators that cut lineage or need a work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Where the setting is unset a temporary folder is made once per session, kept in the session under
    ``letterloom.checkpoint.dir`` and removed when the driver ends; only on one machine (master ``local``), since the
    executors of a cluster don't share it: there the setting is needed.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    own = spark.conf.get("letterloom.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="letterloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set("letterloom.checkpoint.dir", own)
    return own


def checkpoint(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder; survives the loss of an executor.

    Not for rounds over their own result: a checkpoint keeps the estimated size of its plan, and a join multiplies the sizes
    of its sides, so the estimate gets twice as many digits in each round until it fills the driver's heap. There
    ``written`` is used, whose size is that of its files.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back (columnar, prunable)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table of ``written`` that nothing reads any more, as that of the round before."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)
