"""DataFrame -> DataFrame operators: ingest, merge, reconcile, reports."""
