"""harrow: page, document and event analytics expressed as PySpark plans."""
