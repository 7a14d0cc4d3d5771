"""custspark: customer analytics as Spark DataFrame operators.

Sub-packages
------------
sources    readers, writers and the views that shape raw tables
functions  column-level expressions (no Python UDFs)
operators  table-level operators: cleaning, joins, profiles, windows,
           market baskets, features, models, metrics, what-if levers
plans      multi-step plans (customer-360, scoring) and the query catalogue
streaming  incremental audit-log ingestion with Structured Streaming
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Python code that runs inside tasks (``mapInPandas`` steps) is pickled
    by value, so executors need not have this package installed or on
    their path."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle
        pass


_ship_by_value()
