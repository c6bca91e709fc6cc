"""Written tables between the steps of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from heliotide.session import cut_lineage

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, options: dict[str, str] | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back; the shuffle files of its plan are removed once it is written.

    Disk then holds the shuffles of one step at a time. The plan is never run
    again, so nobody misses them; executors lost before the write ends are
    handled as always. ``options`` are the
    writer's, ``settings`` the session's while it writes.
    """
    conf = df.sparkSession.conf
    settings = {CLEANUP: "true", **(settings or {})}
    before = {key: conf.get(key, None) for key in settings}
    for key, value in settings.items():
        conf.set(key, value)
    try:
        return cut_lineage(df, options=options)
    finally:
        for key, value in before.items():
            if value is None:
                conf.unset(key)
            else:
                conf.set(key, value)
