"""The stateful operators as structured streams, and replay of a table through one.

State is kept by key and bounded by time: what the batch operators look back for, a stream remembers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.enrich import CONNECTION, GRAVE_SECONDS
from ..sources.shared import shared_path

#: Rows of a slice of a replay, about.
SLICE_ROWS = 1_000_000


def with_snapshot(starts: DataFrame, snapshot: DataFrame, at: int) -> DataFrame:
    """Process starts with those already running when collection began, as if they had started at `at`."""
    return starts.unionByName(snapshot.withColumn("seq", F.lit(at).cast("long")))


def first_connections(stream: DataFrame, key: tuple[str, ...] = CONNECTION) -> DataFrame:
    """The first event of each connection.  The state is the keys seen; with a watermark on the stream use `first_connections_within`."""
    return stream.dropDuplicates(list(key))


def first_connections_within(stream: DataFrame, at: str, horizon: str, key: tuple[str, ...] = CONNECTION) -> DataFrame:
    """The first event of each connection within a horizon of event time, after which the key is forgotten."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark(list(key))


def process_state(stream: DataFrame, grave: int = GRAVE_SECONDS) -> DataFrame:
    """Probes (kind `probe`) with the image of the process under their pid, from the starts and stops in the same stream (seq, pid, kind, Image)."""
    rank = {"start": 0, "probe": 1, "stop": 2}

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        image, begun, stopped = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(batches))
        rows = rows.assign(__k=rows["kind"].map(rank)).sort_values(["seq", "__k"])
        out = []
        for seq, kind, own in zip(rows["seq"].tolist(), rows["kind"].tolist(), rows["Image"].tolist(), strict=True):
            if kind == "start":
                image, begun, stopped = own, seq, None
            elif kind == "stop":
                stopped = seq
            else:
                live = begun is not None and (stopped is None or stopped < begun or seq - stopped <= grave)
                out.append((seq, key[0], image if live else None))
        state.update((image, begun, stopped))
        yield pd.DataFrame(out, columns=["seq", "pid", "proc_Image"])

    return stream.groupBy("pid").applyInPandasWithState(walk, "seq long, pid long, proc_Image string", "image string, begun long, stopped long", "append", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, table: DataFrame, flow: Callable[[DataFrame], DataFrame], order: str | None = "seq") -> DataFrame:
    """What a stream over `table` gives, all of it read as it is: the table is written once, streamed, and the result read back.

    With an `order` it is cut into slices of about `SLICE_ROWS` rows, each a sorted file that arrives when those before it are done and is read by one
    task: the flow meets all rows in order and holds one slice at a time.  Without one, for flows that look at each row by itself, files of any number
    and order are one batch."""
    at = shared_path(spark, "replay")
    if order is None:
        table.write.parquet(f"{at}/in")
    else:
        slices = max(1, -(-table.count() // SLICE_ROWS))
        table.repartitionByRange(slices, order).sortWithinPartitions(order).write.parquet(f"{at}/slices")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{at}/in"))
    stream = spark.readStream.schema(table.schema).parquet(f"{at}/in")
    out = flow(stream if order is None else stream.coalesce(1))
    sink = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
    if order is None:
        sink.trigger(availableNow=True).start().awaitTermination()
    else:
        q = sink.start()
        try:
            names = [f.getPath().getName() for f in fs.listStatus(path(f"{at}/slices"))]
            for name in sorted((n for n in names if n.startswith("part-")), key=lambda n: int(n.split("-")[1])):
                if not fs.rename(path(f"{at}/slices/{name}"), path(f"{at}/in/{name}")):
                    raise OSError(f"{name} cannot be moved")
                q.processAllAvailable()
        finally:
            q.stop()
    return spark.read.schema(out.schema).parquet(f"{at}/out")
