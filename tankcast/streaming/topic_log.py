"""A topic log that Spark writes and reads (S1, S2): the data source ``topic_log``.

Sink, in two phases.  A task writes Parquet files, one a topic, under names of
its own and reports them.  When all tasks of a micro-batch have succeeded, the
driver commits the epoch: it writes one manifest naming the files, which appears
by a rename.  Files that no manifest names don't exist for readers, so a task
killed half-way leaves nothing visible, and a replayed epoch finds its manifest
and drops its new files.  With output mode ``complete`` an epoch replaces all
before it; a reader sees the old rows or the new ones.  Every ``COMPACT`` epochs
the manifests become one snapshot.  One query writes a log.

Source.  A reader subscribed to topics (option ``topics``, comma-separated; all,
if not given) opens only those topics' files.  A stream's offset is the last
epoch consumed of each topic, kept by Spark's checkpoint, so a restart goes on
behind it.

Paths are local paths or URIs that pyarrow's file systems know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader,
                                    InputPartition, WriterCommitMessage)

from tankcast.session import ship_package

COMPACT = 10
SNAPSHOT = ".snapshot.json"
#: Rows read at a time.
BATCH = 1 << 16


def file_system(path: str):
    from pyarrow import fs
    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Entry(InputPartition):
    """A committed file."""

    epoch: int
    topic: str | None
    file: str
    rows: int


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str | None, str, int]]


# --- manifests ---------------------------------------------------------------------

class Log:
    def __init__(self, path: str):
        self.fs, self.root = file_system(path.rstrip("/"))

    def names(self) -> list[str]:
        from pyarrow import fs
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/manifest", allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".json"))

    def load(self, name: str) -> dict:
        with self.fs.open_input_stream(f"{self.root}/manifest/{name}") as f:
            return json.loads(f.read())

    def publish(self, name: str, content: dict) -> None:
        self.fs.create_dir(f"{self.root}/manifest")
        hidden = f"{self.root}/manifest/{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(hidden) as f:
            f.write(json.dumps(content).encode())
        self.fs.move(hidden, f"{self.root}/manifest/{name}")

    def committed(self) -> tuple[int, list[Entry]]:
        """The last epoch (-1: none) and the files that readers see."""
        while True:
            names = self.names()
            snapshots = [n for n in names if n.endswith(SNAPSHOT)]
            try:
                epoch, files = -1, []
                if snapshots:
                    content = self.load(snapshots[-1])
                    epoch, files = content["epoch"], [Entry(*f) for f in content["files"]]
                for content in [self.load(n) for n in names if not n.endswith(SNAPSHOT) and int(n[:-5]) > epoch]:
                    epoch = content["epoch"]
                    files = [] if content["replace"] else files
                    files += [Entry(epoch, *f) for f in content["files"]]
                return epoch, files
            except FileNotFoundError:  # made into a snapshot meanwhile
                continue

    def commit(self, epoch: int, files: list, replace: bool) -> bool:
        """False, if the epoch stands already."""
        last, _ = self.committed()
        if epoch <= last:
            return False
        self.publish(f"{epoch:020d}.json", {"epoch": epoch, "replace": replace, "files": files})
        if epoch % COMPACT == COMPACT - 1:
            self.compact()
        return True

    def compact(self) -> None:
        names = self.names()
        epoch, files = self.committed()
        kept = f"{epoch:020d}{SNAPSHOT}"
        self.publish(kept, {"epoch": epoch, "files": [[f.epoch, f.topic, f.file, f.rows] for f in files]})
        for name in names:
            if name != kept:
                self.fs.delete_file(f"{self.root}/manifest/{name}")

    def drop(self, files: list) -> None:
        for _, name, _ in files:
            self.fs.delete_file(f"{self.root}/{name}")


# --- sink --------------------------------------------------------------------------

class Writer(DataSourceStreamArrowWriter):
    def __init__(self, path: str, replace: bool):
        self.path, self.replace = path, replace

    def write(self, iterator: Iterator) -> Written:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        log, writers, rows = Log(self.path), {}, {}
        try:
            for batch in iterator:
                topics = batch.column(batch.schema.get_field_index("topic"))
                for topic in pc.unique(topics).to_pylist():
                    some = batch.filter(pc.is_null(topics) if topic is None else pc.equal(topics, topic))
                    if topic not in writers:
                        folder = f"data/{'null' if topic is None else 'topic=' + quote(topic, safe='')}"
                        log.fs.create_dir(f"{log.root}/{folder}")
                        name = f"{folder}/{uuid.uuid4().hex}.parquet"
                        stream = log.fs.open_output_stream(f"{log.root}/{name}")
                        writers[topic], rows[topic] = (name, stream, pq.ParquetWriter(stream, batch.schema)), 0
                    writers[topic][2].write_table(pa.Table.from_batches([some]))
                    rows[topic] += some.num_rows
        finally:
            for _, stream, writer in writers.values():
                writer.close()
                stream.close()
        return Written([(topic, name, rows[topic]) for topic, (name, _, _) in writers.items()])

    def commit(self, messages, batchId: int) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        log = Log(self.path)
        if not log.commit(batchId, files, self.replace):
            log.drop(files)

    def abort(self, messages, batchId: int) -> None:
        Log(self.path).drop([f for m in messages if m is not None for f in m.files])


# --- source ------------------------------------------------------------------------

class Files:
    """Reads committed files of the subscribed topics."""

    def __init__(self, path: str, topics: list[str] | None, schema):
        self.path, self.topics, self.columns = path, topics, schema.names

    def mine(self, entries: list[Entry]) -> list[Entry]:
        return [e for e in entries if self.topics is None or e.topic in self.topics]

    def read(self, partition: Entry | None) -> Iterator:
        import pyarrow.parquet as pq
        if partition is None:  # how Spark reads a source without partitions
            return
        log = Log(self.path)
        with log.fs.open_input_file(f"{log.root}/{partition.file}") as f:
            yield from pq.ParquetFile(f).iter_batches(batch_size=BATCH, columns=self.columns)


class BatchReader(Files, DataSourceReader):
    def partitions(self):
        return self.mine(Log(self.path).committed()[1])


class StreamReader(Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out: dict[str, int] = {}
        for e in self.mine(Log(self.path).committed()[1]):
            key = json.dumps(e.topic)
            out[key] = max(e.epoch, out.get(key, -1))
        return out

    def partitions(self, start: dict, end: dict):
        return [e for e in self.mine(Log(self.path).committed()[1])
                if start.get(json.dumps(e.topic), -1) < e.epoch <= end.get(json.dumps(e.topic), -1)]

    def commit(self, end: dict) -> None:
        pass


class TopicLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> str:
        return "topic string, payload string, ts timestamp_ntz"

    def subscribed(self) -> list[str] | None:
        topics = self.options.get("topics")
        return topics.split(",") if topics else None

    def reader(self, schema):
        return BatchReader(self.options["path"], self.subscribed(), schema)

    def streamReader(self, schema):
        return StreamReader(self.options["path"], self.subscribed(), schema)

    def streamWriter(self, schema, overwrite: bool):
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(TopicLog)


def write_topic_log(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                    output_mode: str = "append", name: str | None = None):
    """Start a query that publishes the streaming ``df`` (with a column ``topic``)."""
    register(df.sparkSession)
    w = df.writeStream.format("topic_log").option("path", path).option("checkpointLocation", checkpoint)
    w = w.queryName(name) if name else w
    return w.outputMode(output_mode).trigger(**(trigger or {"processingTime": "1 second"})).start()


def read_topic_log(spark: SparkSession, path: str, schema: str, topics: list[str] | None = None,
                   stream: bool = False) -> DataFrame:
    """The committed rows of a log, of ``topics`` only if given."""
    register(spark)
    r = (spark.readStream if stream else spark.read).format("topic_log").schema(schema).option("path", path)
    return (r.option("topics", ",".join(topics)) if topics else r).load()
