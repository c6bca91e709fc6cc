"""Spark-native hourly time-series engine for day-ahead energy forecasting.

Frames are keyed by ``series_id`` and ``ts``; both must be non-null, and the
pair unique wherever row order matters. Every operator is a lazy
DataFrame-to-DataFrame function unless its name starts with ``check_``,
``fit_``, ``write_`` or ``publish_``.
"""

SERIES = "series_id"
TS = "ts"
