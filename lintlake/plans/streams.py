"""Queries that run as micro-batches until their input is read."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from lintlake.operators import extract
from lintlake.sources.tables import ensure_checkpoint_dir, table
from lintlake.streaming import incremental


def _glob(d: str, name: str) -> str:
    """A pattern that a table's file or folder matches, as streams read folders."""
    return f"{d}/{re.sub('(.)$', '[\\1]', name)}.parquet"


def stream_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints of stored files, extracted batch by batch."""
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = incremental.document_stream(spark, _glob(d, "fetched_files"), table(spark, d, "fetched_files").schema)
    incremental.write_findings(docs, {"endpoints": extract.endpoints}, root, f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/endpoints").select("file_id", "source_url", "pattern_name", "value")


def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Pattern and value of endpoints, once each, as they arrive."""
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = incremental.document_stream(spark, _glob(d, "endpoints"), table(spark, d, "endpoints").schema, files_per_batch=1)
    incremental.write_first_seen(rows.select("pattern_name", "value"), ["pattern_name", "value"], f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("pattern_name", "value")


QUERIES = {f.__name__: f for f in (stream_endpoints, stream_first_seen)}
ORACLES = {"stream_first_seen": "select distinct pattern_name, value from endpoints"}


def _endpoints_sql() -> str:
    from lintlake.functions import patterns as P
    from lintlake.plans import duck as D

    return f"select distinct file_id, url as source_url, name as pattern_name, value from {D.hits('fetched_files', P.ENDPOINTS)} where value <> ''"


ORACLES["stream_endpoints"] = _endpoints_sql()
