"""hazecast: hourly air-quality and weather analytics on Spark.

Every operator takes and returns a Spark ``DataFrame`` keyed by ``series_id``;
nothing is computed on the driver except small per-feature matrices and model
metrics.  Sub-packages:

* ``sources``   – table scans, payload explode, sinks, model registry
* ``functions`` – scalar ``Column`` builders (AQI, calendar, numeric helpers)
* ``operators`` – cleaning, windows, features, rollups, selection, models,
                  evaluation and forecasting
* ``plans``     – the registered queries and their DuckDB oracle SQL
* ``streaming`` – Structured Streaming upserts and windowed rollups
"""

from hazecast.session import get_spark, shared_dir


def _pickle_by_value() -> None:
    """Python functions shipped to executors (the grouped-map pandas step)
    are serialised with their code, so executors need no installed copy of
    this package – the same effect as ``--py-files`` without staging files."""
    try:
        import sys

        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: rely on --py-files
        pass


_pickle_by_value()

__all__ = ["get_spark", "shared_dir"]
