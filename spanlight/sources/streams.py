"""Live sources as streams of text lines, and looking into a running stream.

Every reader gives one column ``value``; :func:`spanlight.sources.formats.parse_lines` takes it from there. Reading and
acknowledging, replay after a failure and back-pressure are what Structured Streaming's sources and checkpoints do.
"""

from __future__ import annotations

import socket as sockets
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def read_drops(spark: SparkSession, folder: str, at_once: int = 1000) -> DataFrame:
    """Files put into a folder: what a collector that takes posted events, or a piped standard input, writes."""
    return spark.readStream.option("maxFilesPerTrigger", at_once).text(folder)


def read_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a TCP socket (for trying things out: a socket cannot be read again)."""
    return spark.readStream.format("socket").options(host=host, port=port).load()


def read_topic(spark: SparkSession, servers: str, topic: str, starting: str = "latest", **options: str) -> DataFrame:
    """Messages of a broker's topic. Needs Spark's connector on the class path."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).options(**options).load()
    return rows.select(F.col("value").cast("string").alias("value"))


class UnixLines(DataSource):
    """``format("unix_lines")``: lines that arrive on a Unix socket, read by the driver in small batches."""

    @classmethod
    def name(cls) -> str:
        return "unix_lines"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802 - Spark's name
        return _UnixReader(self.options["path"], float(self.options.get("wait_s", "0.2")))


class _UnixReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, wait_s: float) -> None:
        self.path, self.wait_s, self.link, self.rest = path, wait_s, None, b""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"line": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.link is None:
            self.link = sockets.socket(sockets.AF_UNIX, sockets.SOCK_STREAM)
            self.link.settimeout(self.wait_s)
            self.link.connect(self.path)
        lines: list[tuple] = []
        try:
            while chunk := self.link.recv(1 << 16):
                *whole, self.rest = (self.rest + chunk).split(b"\n")
                lines += [(x.decode(errors="replace"),) for x in whole]
        except TimeoutError:
            pass
        return iter(lines), {"line": start["line"] + len(lines)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802 - a socket cannot be read again
        return iter(())

    def commit(self, end: dict) -> None:
        pass


def tap(rows: DataFrame, share: float = 1.0, seed: int = 7) -> DataFrame:
    """A sample of the raw or decoded events, or of the live detections, of a running stream or a table."""
    return rows if share >= 1 else rows.sample(share, seed)


def watch(stream: DataFrame, show: Callable[[list], None], at_most: int = 20, share: float = 1.0, checkpoint: str | None = None):
    """Start looking into a stream: of every micro-batch up to ``at_most`` (sampled) rows are handed to ``show``."""
    def each(batch: DataFrame, number: int) -> None:
        show(tap(batch, share).limit(at_most).collect())

    writer = stream.writeStream.foreachBatch(each)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
