"""ridegrid: batch and streaming analytics for an hourly vehicle-rental fleet on PySpark.

Sub-packages:

* ``sources``   typed table loading (test-data adapter, seed rows, JDBC options, sinks)
* ``functions`` shared Column expressions (discounts, prices, labels, messages)
* ``operators`` reporting views, data-quality rules, set-based commands, audit
* ``plans``     the query registry and the DuckDB oracle texts
* ``streaming`` Structured Streaming versions of audit and command application
"""

from ridegrid.session import configure, get_session

__all__ = ["configure", "get_session"]
