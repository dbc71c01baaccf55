"""Reference checks of child rows that arrive as a stream, batch by batch, against a parent table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.checks import reference_facts


def check_stream(stream: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str], out: str, checkpoint: str, policy: str = "allow_any_null") -> StreamingQuery:
    """Facts of each batch's foreign key, one Parquet folder a batch: a batch that runs again replaces its own."""

    def check(batch: DataFrame, number: int) -> None:
        reference_facts(batch, columns, parent, parent_columns, policy).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
