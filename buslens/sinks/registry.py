"""Sinks by name."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from buslens.sources.catalogue import Catalogue


class FrameSink(ABC):
    """Writes a frames table somewhere.

    Batch writes go to ``path``. Micro-batches pass ``batch_id`` and go to
    ``path/batch_id=N``, replacing what a failed attempt may have left, so a
    replayed batch is written once.
    """

    def __init__(self, path: str | None = None, catalogue: Catalogue | None = None):
        self.path = path
        self.catalogue = catalogue

    def prepare(self, frames: DataFrame, batch_id: int | None) -> DataFrame:
        """The rows to write, one per frame."""
        return frames

    @abstractmethod
    def save(self, rows: DataFrame, path: str | None, batch_id: int | None) -> None:
        """Write prepared rows; ``path`` is where this batch belongs."""

    def write(self, frames: DataFrame, batch_id: int | None = None) -> int:
        """Write ``frames`` and return how many there were, counted on the way."""
        rows = self.prepare(frames, batch_id)
        # Counted behind every shuffle: a range partitioning reads its input twice.
        counter = Observation()
        self.save(rows.observe(counter, F.count(F.lit(1)).alias("frames")), self.batch_path(batch_id), batch_id)
        return counter.get["frames"]

    def batch_path(self, batch_id: int | None) -> str | None:
        if self.path is None or batch_id is None:
            return self.path
        return f"{self.path}/batch_id={batch_id}"


class DataSourceSink(FrameSink):
    """A custom write format, any ``pyspark.sql.datasource.DataSource``."""

    def __init__(self, source: type[DataSource], path=None, catalogue=None, mode: str = "append", **options):
        super().__init__(path, catalogue)
        self.source, self.mode, self.options = source, mode, options

    def save(self, rows, path, batch_id):
        rows.sparkSession.dataSource.register(self.source)
        writer = rows.write.format(self.source.name()).mode(self.mode).options(**self.options)
        writer.save(path) if path is not None else writer.save()


class SinkRegistry:
    """Names for sink classes; ``sinks`` below is the one in common use."""

    def __init__(self) -> None:
        self._kinds: dict[str, type] = {}

    def register(self, name: str):
        """Class decorator: make a sink or a custom data source known by name."""

        def add(kind: type) -> type:
            if not name or " " in name:
                raise ValueError(f"a sink name must be non-empty and without spaces, got {name!r}")
            if name in self._kinds:
                raise ValueError(f"there is already a sink named {name!r}")
            if not (isinstance(kind, type) and issubclass(kind, (FrameSink, DataSource))):
                raise TypeError(f"{kind!r} is neither a FrameSink nor a DataSource")
            self._kinds[name] = kind
            return kind

        return add

    def create(self, name: str, **options) -> FrameSink:
        kind = self._kinds.get(name)
        if kind is None:
            raise ValueError(f"cannot write as {name!r}: known sinks are {self.names()}")
        return kind(**options) if issubclass(kind, FrameSink) else DataSourceSink(kind, **options)

    def names(self) -> list[str]:
        """Names in order of registration."""
        return list(self._kinds)


sinks = SinkRegistry()
