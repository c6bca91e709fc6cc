import os

import numpy as np
import pandas as pd
import pytest

from heliotide.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "4"}
    if "SPARK_CHECKPOINT_DIR" not in os.environ:
        conf["spark.checkpoint.dir"] = str(tmp_path_factory.mktemp("shared"))
    session = local_session(8, **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def hourly(spark):
    """Two interleaved series of different length, with missing values and absent hours."""
    rng = np.random.default_rng(7)
    parts = []
    for name, n, level in (("a", 300, 50.0), ("b", 170, 1000.0)):
        ts = pd.date_range("2024-01-01", periods=n, freq="h")
        y = pd.Series(level + rng.normal(0, 10, n))
        y[rng.random(n) < 0.3] = np.nan
        part = pd.DataFrame({"series_id": name, "ts": ts, "y": y, "x": rng.normal(0, 1, n)})
        parts.append(part[rng.random(n) > 0.1])
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, to_spark(spark, pdf)


def to_spark(spark, pdf):
    """Spark frame with zone-less times and NULL for missing."""
    types = {"O": "string", "f": "double", "i": "bigint", "b": "boolean", "M": "timestamp_ntz"}
    schema = ", ".join(f"`{c}` {types.get(pdf[c].dtype.kind, 'string')}" for c in pdf.columns)
    rows = [
        tuple(None if pd.isna(x) else (x.to_pydatetime() if isinstance(x, pd.Timestamp) else (x.item() if hasattr(x, "item") else x)) for x in row)
        for row in pdf.itertuples(index=False)
    ]
    return spark.createDataFrame(rows, schema)


def ordered(df, *keys):
    return df.toPandas().sort_values(list(keys or ("series_id", "ts"))).reset_index(drop=True)


def per_series(pdf, fn):
    """Apply ``fn`` to each series in time order; columns back in key order."""
    parts = [fn(part.sort_values("ts").copy()) for _, part in pdf.groupby("series_id")]
    return pd.concat(parts).sort_values(["series_id", "ts"]).reset_index(drop=True)


def same(a, b, tol=1e-9):
    np.testing.assert_allclose(np.asarray(a, dtype=float), np.asarray(b, dtype=float), rtol=tol, atol=tol)
