"""A streaming source of synthetic log records with Kafka's columns, for tests and demonstrations without a broker."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class OffsetLogSource(DataSource):
    """format("offsetlog"): options messages, keys, partitions, batch. Record i has key key-(i % keys), partition i % partitions."""

    @classmethod
    def name(cls) -> str:
        return "offsetlog"

    def schema(self) -> str:
        return "topic string, partition int, offset bigint, key binary, value binary"

    def simpleStreamReader(self, schema):
        return OffsetLogReader(self.options)


class OffsetLogReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.total, self.keys = int(options.get("messages", 1000)), int(options.get("keys", 10))
        self.partitions, self.batch = int(options.get("partitions", 4)), int(options.get("batch", 100))

    def initialOffset(self) -> dict:
        return {"next": 0}

    def _rows(self, start: int, end: int) -> Iterator[tuple]:
        for i in range(start, end):
            key = f"key-{i % self.keys}"
            yield ("bench", i % self.partitions, i // self.partitions, key.encode(), f'{{"key":"{key}","sequence":{i // self.keys},"timestamp":0}}'.encode())

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(self.total, start["next"] + self.batch)
        return iter(list(self._rows(start["next"], end))), {"next": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(start["next"], end["next"])

    def commit(self, end: dict) -> None:
        return None
