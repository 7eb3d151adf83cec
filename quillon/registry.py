"""The library's own queries, and how a query's session gets the package."""

from __future__ import annotations

import functools
import io
import os
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon import storage

Query = Callable[[SparkSession, str], DataFrame]

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, once a Spark application, so that theirs needn't have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for at, _, names in os.walk(here):
            for name in names:
                if not name.endswith(".pyc"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    # The archive lies in the shared folder, like the tables.
    path = f"{storage.own_dir(spark)}-package/quillon.zip"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(packed.getvalue())
    out.close()
    spark.sparkContext.addPyFile(path)


def shipped(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the DuckDB SQL that gives the same rows, if there is any."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from quillon import plans  # noqa: F401

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from quillon import plans  # noqa: F401

    return dict(_sql)
