"""Call record analytics on Spark: parse records, fold them into counters, answer from those.

``sources`` reads and writes records, ``operators`` are plain functions from DataFrame to
DataFrame, ``plans`` holds the store and the registered queries, ``streaming`` feeds the store.
"""

from ringledger.plans.store import Store
from ringledger.streaming.ingest import ingest_file_stream, ingest_files, ingest_stream

__all__ = ["Store", "ingest_file_stream", "ingest_files", "ingest_stream"]
