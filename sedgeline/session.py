"""What every job needs of its session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Arrow batches end at so many bytes, so that long texts don't fill an executor's memory; a setting of the session's own that is lower stays.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, so that their Python workers can import it wherever it is installed; bounds Arrow batches."""
    sc = spark.sparkContext
    if sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)
    if getattr(sc, "_sedgeline_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sedgeline-")) / "sedgeline_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(target))
    sc._sedgeline_shipped = True


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt to some tasks for each core, by the columns ``by`` if given: rows that take long to work out may all lie in one small file, which is one task. The number is given, so that Spark doesn't put small parts together again."""
    spark = df.sparkSession
    n = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *by)
