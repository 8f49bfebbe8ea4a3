"""Session helpers: where intermediate tables are written and how lineage is cut.

Intermediate results of iterative operators are written as parquet below the shared folder that the
cluster names in ``spark.checkpoint.dir``. A local session without that setting (tests) gets a folder
of its own; a cluster session without it is refused, because a machine-local folder would not survive
the loss of the executor that wrote it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application, below ``spark.checkpoint.dir``."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="helixframe-")
        _FOLDERS[app] = f"{base.rstrip('/')}/helixframe-{app}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit
        pass


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; DataFrames that still read them become unusable."""
    if (path := _FOLDERS.get(spark.sparkContext.applicationId)) is not None:
        _remove(spark, path)


class Table:
    """A written intermediate table: ``df`` reads it, ``drop()`` deletes it.

    ``stats`` are SQL aggregates over the rows, taken while they are written; their values are in ``seen``.
    """

    def __init__(self, df: DataFrame, name: str, **stats: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        schema = df.schema
        watch = Observation() if stats else None
        (df.observe(watch, *[F.expr(c).alias(k) for k, c in stats.items()]) if watch else df).write.parquet(self.path)
        self.seen = watch.get if watch else {}
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        _remove(self.spark, self.path)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and return a DataFrame that reads it (lineage is cut)."""
    return Table(df, name).df


def session(app: str = "helixframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return b.config(map=base | conf).getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
