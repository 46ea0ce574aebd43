"""tidepool: event-lakehouse operators written as plain PySpark DataFrame jobs.

Layout:
  sources/    readers (driver tables, JSON-lines events, audit logs) and sinks
  functions/  Column builders (predicates, fingerprints, tokens, vectors)
  operators/  DataFrame -> DataFrame operators (CDC, joins, metrics, identity, ...)
  plans/      domain views over the driver tables and the query catalog
  streaming/  Structured Streaming runners sharing the batch transformations
"""

__version__ = "0.1.0"
