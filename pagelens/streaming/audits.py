"""Audits of pages as a stream: each micro-batch is audited like a table, and snapshots are compared with the one before on their journey."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelens.operators.structure import structure_findings
from pagelens.plans.store import stored
from pagelens.sources.html_nodes import html_nodes

TRACKED = ["title", "url", "focus"]


def audit(pages: DataFrame, target: str, checkpoint: str, findings=structure_findings) -> StreamingQuery:
    """Appends the findings of every page of a stream (page_id, html) to a Parquet table; a batch that is run again replaces its own rows, as they are partitioned by its number."""

    def one(batch: DataFrame, number: int) -> None:
        found = findings(stored(html_nodes(batch))).withColumn("batch", F.lit(number))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_changes(snapshots: DataFrame) -> DataFrame:
    """journey_id, step, changed of snapshots (journey_id, step, title, url, focus) that come in order: what differs from the one before, which is all the state that a journey keeps."""

    def compare(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(parts)).sort_values("step")
        out = []
        for r in rows.itertuples():
            now = tuple("" if getattr(r, t) is None else str(getattr(r, t)) for t in TRACKED)
            if last is not None:
                out.append((key[0], r.step, ",".join(t for t, a, b in zip(TRACKED, last, now, strict=True) if a != b)))
            last = now
        state.update(last)
        yield pd.DataFrame(out, columns=["journey_id", "step", "changed"])

    return snapshots.groupBy("journey_id").applyInPandasWithState(compare, "journey_id long, step long, changed string", "title string, url string, focus string", "append", GroupStateTimeout.NoTimeout)
