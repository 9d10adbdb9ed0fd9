"""Row-level detection over a stream, with frozen statistics.

Chunks of rows are judged by statistics taken once, as a batch run would judge
them; cross-row findings need the whole table and stay a batch step.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Config
from ..operators.detect_rows import detect_row_level
from ..operators.stats import Stats


def detect_stream(rows: DataFrame, headers: list[str], stats: Stats, out: str, checkpoint: str, config: Config = DEFAULT) -> StreamingQuery:
    """Findings of every micro-batch under out/batch=<id>.

    A batch that is run again overwrites its own folder, so findings are written once.
    Arriving rows may hold spellings that the statistics have not seen, so none is ruled out.
    """
    open_end = replace(stats, complete=False)

    def judge(batch: DataFrame, batch_id: int) -> None:
        detect_row_level(batch, headers, open_end, config).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return rows.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
