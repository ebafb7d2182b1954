"""Tables written between the steps of an operator, in the folder all executors share, and their removal."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from usagelens.session import shared_dir

#: The folders written within each open scratch block, innermost last.
_open: list[list[str]] = []


#: While a step's table is written: shuffle files go with the step, and batches of rows sent to Python stay small, so that neither
#: Spark's buffers nor a worker's arrays grow with the length of the texts.
STEP = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


@contextmanager
def step_settings(spark: SparkSession, **more: str):
    """The settings of STEP, and those from before afterwards."""
    settings = STEP | {f"spark.sql.execution.arrow.{k}": v for k, v in more.items()}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside the block are removed when it ends, but for those written with ``keep``.

    A result that leaves the block must be a kept table, or be made of tables from outside.
    """
    own: list[str] = []
    _open.append(own)
    try:
        yield
    finally:
        _open.remove(own)
        for path in own:
            _remove(spark, path)


def written(df: DataFrame, purpose: str, keep: bool = False, records: int = 1000) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: later steps read it, also after a lost executor.

    ``keep`` lets the table outlive the innermost scratch block; it goes with the next one around it.  ``records`` is for rows of
    numbers: so many go to Python at once, within the bytes of STEP.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    holders = _open[:-1] if keep else _open
    if holders:
        holders[-1].append(path)
    with step_settings(spark, maxRecordsPerBatch=str(records)):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Removes a table that written() gave and nothing reads any more."""
    files = table.inputFiles()
    if files:
        _remove(table.sparkSession, files[0].rsplit("/", 1)[0])
