"""A session with the settings every operator is planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def default_session(app: str = "vellichor", master: str | None = None, **conf: str) -> SparkSession:
    """Builds (or gets) a session: AQE on, UTC, Arrow for Python exchange.

    Shuffle partitions are left to AQE: the initial number is only an upper
    bound that coalescing reduces. Extra settings are given with ``_`` for ``.``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.unionOutputPartitioning": "false",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("_", "."): v for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def steady(spark: SparkSession) -> SparkSession:
    """Turns off a 4.1 planner rule under which AQE may zip unions of unequally coalesced shuffles, which fails."""
    if spark.conf.get("spark.sql.unionOutputPartitioning", None) == "true":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark
