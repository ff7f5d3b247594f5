"""Session construction and the two session-level services jobs rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # Checkpoints go once nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "panelwright", master: str | None = None, **extra: str) -> SparkSession:
    """Session with adaptive execution on and a fixed UTC clock.

    ``master`` stays unset on a cluster, where spark-submit provides it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, as the cluster names it.

    Only a local-mode session without one gets a temporary folder: on a cluster a
    machine-local folder is lost with its executor, so there its absence is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="panelwright-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: iterative jobs survive executor loss and keep short plans."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows that one task of an iterative fit should hold at most.
FIT_ROWS = 10_000


def fit_rows(df: DataFrame, most: int | None = None) -> DataFrame:
    """Rows of a fit, written once, in as many even parts as their number asks for.

    A join of a few numbers per row ends in one or two partitions, as these are cut by bytes; a fit
    that passes over them hundreds of times would use as many cores. Small tables stay as they are.
    ``most`` bounds the parts where every task sends all that the fit learns, as a forest does with
    the histograms of all nodes of all trees: parts beyond the cores then only multiply what is sent.
    """
    rows = cut_lineage(df)
    have, parts = rows.rdd.getNumPartitions(), -(-rows.count() // FIT_ROWS)
    if most is not None:
        have, parts = (0, most) if have > most else (have, min(parts, most))
    return cut_lineage(rows.repartition(parts)) if parts > have else rows
