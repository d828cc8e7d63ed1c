"""Match requests as they arrive: each micro-batch runs the batch plan and is appended to the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from termweave.plans.match import REQUEST, match, requests_of, responses, valid_request
from termweave.sources.audit import save_matches
from termweave.sources.terms import Dictionary


def match_stream(spark: SparkSession, requests_dir: str, dictionary: Dictionary, audit_path: str, checkpoint: str) -> StreamingQuery:
    """Read JSON requests from a folder and store their responses; requests that break a limit are left out; a batch that runs again replaces its requests' rows in ``latest``."""
    arriving = spark.readStream.schema(REQUEST).json(requests_dir)

    def store(batch: DataFrame, _: int) -> None:
        full = requests_of(batch).where(valid_request())
        save_matches(responses(full, match(full, dictionary), dictionary.version), audit_path)

    return arriving.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
