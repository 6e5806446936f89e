"""Trace triage analytics on PySpark: ingest, assemble, score, decide, evaluate."""

__version__ = "0.1.0"
