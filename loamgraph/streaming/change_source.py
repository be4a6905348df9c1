"""A versioned table's changes as a streaming source.

``spark.readStream.format("loamgraph_changes").option("path", ...)`` gives the rows that each commit took in and took out: the table's columns, ``_change`` (insert, or delete with the row as it
was) and ``_version``. An update is a delete and an insert of one version. The offset is the table's version, so a restarted query goes on where its checkpoint ends; a partition is one file of one
commit, read where the task runs, in Arrow batches, without the rows that its deletion vector marks. Options: ``path``; ``starting`` (the version after which to begin, -1 by default).

Files are opened by Arrow's file systems, so the path must be one they know: a shared mount, HDFS, S3 or the like. Commits that only move rows (``same``) are passed over.

``follow`` keeps a second table equal to the first: of each batch the last change of every key is applied in one commit marked by the batch's number, so a batch tried again is not
applied twice. Both tables need a key of which no two rows share a value; rows whose key is null are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from loamgraph.sources.deletion import BITS
from loamgraph.sources.store import CHECKPOINT, LOG_NAME, VersionedTable, tail

FORMAT = "loamgraph_changes"


class Log:
    """The table's log by Arrow's file systems: there is no session where a source's planning runs."""

    def __init__(self, path: str):
        self.files, self.root = arrow_fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (arrow_fs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")

    def json(self, name: str) -> dict | None:
        try:
            with self.files.open_input_stream(f"{self.root}/{name}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def version(self) -> int:
        found = self.files.get_file_info(arrow_fs.FileSelector(f"{self.root}/_log", allow_not_found=True))
        return max((int(f.base_name[:20]) for f in found if LOG_NAME.fullmatch(f.base_name)), default=-1)

    def entry(self, version: int) -> dict:
        return self.json(f"_log/{version:020}.json")

    def state(self, version: int) -> dict:
        at = version // CHECKPOINT * CHECKPOINT
        held = self.json(f"_log/{at:020}.state.json") if at else None
        out = {"files": [], "schema": None, "marks": {}, "info": {}, "vectors": {}} | (held or {})
        for v in range(at + 1 if held else 0, version + 1):
            out = VersionedTable._after(out, self.entry(v))
        return out

    def bitmaps(self, dv: str | None, file: str) -> dict[int, bytes]:
        """By block."""
        if dv is None:
            return {}
        table = pq.read_table(f"{self.root}/deletes/{dv}", filesystem=self.files, filters=[("file", "=", file)], columns=["block", "bits"])
        return dict(zip(table.column("block").to_pylist(), table.column("bits").to_pylist(), strict=True))


@dataclass
class Piece(InputPartition):
    """What one file has to say about one commit: its rows that are in ``marked`` (or all, if that is None) and not in ``unless``."""

    version: int
    file: str
    change: str
    marked: str | None
    unless: str | None


def pieces(log: Log, after: int, upto: int) -> Iterator[Piece]:
    state = log.state(after)
    for v in range(after + 1, upto + 1):
        e = log.entry(v)
        if not e.get("same"):
            dv = lambda f, of: (of.get(f) or {}).get("dv")
            for f in e["add"]:
                yield Piece(v, f, "insert", None, dv(f, e.get("vectors", {})))
            for f in e["remove"]:
                yield Piece(v, f, "delete", None, dv(f, state["vectors"]))
            for f, now in e.get("vectors", {}).items():
                if f not in e["add"] and now:
                    yield Piece(v, f, "delete", now["dv"], dv(f, state["vectors"]))
        state = VersionedTable._after(state, e)


class ChangeReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: T.StructType, starting: int):
        self.path, self.schema, self.starting = path, schema, starting

    def initialOffset(self) -> dict:  # noqa: N802  names of Spark's interface
        return {"version": self.starting}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"version": Log(self.path).version()}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return list(pieces(Log(self.path), start["version"], end["version"]))

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the log is the table's."""

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        log, names, kinds = Log(self.path), [f.name for f in self.schema.fields[:-2]], to_arrow_schema(self.schema)
        marked = log.bitmaps(partition.marked, tail(partition.file)) if partition.marked else None
        unless = log.bitmaps(partition.unless, tail(partition.file))
        at = 0
        with log.files.open_input_file(f"{log.root}/{partition.file}") as f:
            for batch in pq.ParquetFile(f, coerce_int96_timestamp_unit="us").iter_batches(columns=names):
                n = batch.num_rows
                if marked is not None or unless:
                    keep = ~held(unless, at, n) & (True if marked is None else held(marked, at, n))
                    batch = batch.filter(pa.array(keep, pa.bool_()))
                at += n
                own = [batch.column(c).cast(kinds.field(c).type) for c in names]
                marks = [pa.array([partition.change] * batch.num_rows, pa.string()), pa.array([partition.version] * batch.num_rows, pa.int64())]
                yield pa.RecordBatch.from_arrays([*own, *marks], schema=kinds)


def held(bits: dict[int, bytes], first: int, n: int) -> np.ndarray:
    """For ``n`` rows from ``first`` on, whether their bits are set."""
    lo, size = first >> BITS, 1 << BITS
    blocks = range(lo, ((first + n - 1) >> BITS) + 1)
    none = np.zeros(size, np.uint8)
    own = [np.unpackbits(np.frombuffer(bits[b], np.uint8), bitorder="little") if b in bits else none for b in blocks]
    return np.concatenate([*own, none[:0]])[first - (lo << BITS) :][:n].astype(bool)


class ChangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        log = Log(self.options["path"])
        version = log.version()
        if version < 0:
            raise ValueError(f"no table at {self.options['path']}")
        own = T.StructType.fromJson(log.entry(version)["schema"])
        return T.StructType([*own.fields, T.StructField("_change", T.StringType()), T.StructField("_version", T.LongType())])

    def streamReader(self, schema: T.StructType) -> ChangeReader:  # noqa: N802
        return ChangeReader(self.options["path"], schema, int(self.options.get("starting", "-1")))


def change_stream(spark: SparkSession, table: VersionedTable, **options) -> DataFrame:
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format(FORMAT).options(path=table.root, **options).load()


def last_of_key(batch: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of every key; in one version what came in counts, not what it replaced."""
    names = [c for c in batch.columns if c not in ("_change", "_version")]
    order = F.struct("_version", (F.col("_change") == "insert").alias("_in"))
    known = batch.filter(" and ".join(f"`{k}` is not null" for k in keys))
    last = known.groupBy(*keys).agg(F.max_by(F.struct(*[f"`{c}`" for c in names], "_change"), order).alias("_last"))
    return last.select("_last.*")


def follow(source: VersionedTable, target: VersionedTable, checkpoint: str, **options) -> int:
    """Bring ``target`` up to ``source``; returns its version."""
    if not target.keys:
        raise ValueError("only a table with keys can follow another")

    def apply(batch: DataFrame, number: int) -> None:
        mark = f"{checkpoint}#{number}"
        if not target.done(mark):
            target.apply(last_of_key(batch.persist(), target.keys), mark)
            batch.unpersist()

    stream = change_stream(source.spark, source, **options)
    run = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()
    run.awaitTermination()
    return target.version()
