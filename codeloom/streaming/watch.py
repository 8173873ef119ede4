"""Change capture (rows T1-T3, T5): debounced batches of changed paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import is_code_file


def debounced(events: DataFrame, gap: str = "300 milliseconds", lateness: str | None = None) -> DataFrame:
    """(root, paths, events, first_at, last_at) of each run of ``events(root, path, ts)`` without a pause of ``gap``.

    The same program over a stream takes ``lateness`` as its watermark.
    """
    e = events.withWatermark("ts", lateness) if lateness else events
    runs = e.groupBy("root", F.session_window("ts", gap)).agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count("*").alias("events"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return runs.select("root", "paths", "events", "first_at", "last_at")


def relevant(events: DataFrame) -> DataFrame:
    """T2."""
    return events.where(is_code_file(F.col("path")))


def rebuilding(builder, root: str, folder: str, registry: str, failed: Callable[[str], None] = print) -> Callable[[DataFrame, int], None]:
    """What ``watch`` runs for a batch: a build of ``root`` kept in ``folder`` and a row in the registry. A failed build is told and leaves the last one."""
    from codeloom.exports.records import track
    from codeloom.plans.build import BuildRequest, identity_of
    from codeloom.plans.reuse import read_build, write_build

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        try:
            out = builder.run(BuildRequest(root), read_build(builder.spark, folder))
            if out.mode != "reused":
                write_build(out.graph, out.manifest, folder, out.rows)
            remote, name = identity_of(root)
            track(builder.spark, registry, root, name, remote, f"{folder}/nodes")
        except Exception as e:  # noqa: BLE001  the next change builds again
            failed(f"update failed: {e}")

    return run


def watch(events: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "300 milliseconds", lateness: str = "1 minute", **trigger):
    """Runs ``rebuild`` for each batch of debounced changes of a stream; returns the started query."""
    runs = debounced(relevant(events), gap, lateness)
    writer = runs.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(rebuild)
    return (writer.trigger(**trigger) if trigger else writer).start()
