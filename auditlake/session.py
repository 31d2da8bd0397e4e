"""SparkSession helpers: one place for the configuration the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "auditlake", conf: dict | None = None,
              driver_memory: str = "8g") -> SparkSession:
    """Build (or reuse) a session with AQE, UTC and the UI off."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    merged = dict(DEFAULT_CONF)
    merged["spark.driver.memory"] = driver_memory
    merged.update(conf or {})
    for k, v in merged.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster setting always wins; a private scratch folder is created
    only when nothing is configured and the master is local (tests), as other
    machines could not read it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        d = tempfile.mkdtemp(prefix="auditlake-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - some deployments reject runtime core confs
            pass
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``auditlake`` importable in executor Python workers (like ``--py-files``).

    Zips the package once per SparkContext and registers it with
    ``addPyFile``; needed only by operators that run Python inside tasks.
    """
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="auditlake-pyfiles-")) / "auditlake.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in pkg.rglob("*.py"):
            z.write(p, Path("auditlake") / p.relative_to(pkg))
    sc.addPyFile(str(out))
    _SHIPPED.add(key)
