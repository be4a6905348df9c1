"""Versioned tables: Parquet files and a log of JSON commits.

A table is a folder. Each commit writes files and then one log entry, ``_log/{version}.json``, put in place only if the version isn't there, so a commit is seen whole or not at all and
of two writers one has to try again: by a hard link on a local disk, else by a rename that must not overwrite. That is safe on HDFS and stores with its rename; on a store whose rename copies
(most object stores) only one writer may commit at a time. A version's rows are its live files, added and not removed since, without the rows marked in deletion vectors.

Upserts and deletes write new rows and marks only (``merge``, the default): old files stay as they are, readers leave out what is marked, and change feeds know the rows that went from
the marks. ``compact`` writes files anew that lost many rows.

Keyed tables with ``buckets`` are cut by a hash of the keys (nulls too), or of the columns ``by``, one folder each and sorted by them. An upsert looks for old rows in
the buckets that its new rows fall into, and in no other; readers that know what they look for read its buckets only.

The log has bounds of each file's columns, and Bloom filters beside the data, so a filtered scan opens only files that can hold its rows.

Every ``CHECKPOINT`` commits the log's state is written beside the entry, so opening a table reads a bounded number of entries.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from contextlib import suppress
from functools import reduce

import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgraph.session import swept
from loamgraph.sources import deletion, file_stats
from loamgraph.sources.changes import difference
from loamgraph.sources.deletion import FILE, ROW

BUCKET, GONE = "_bucket", "_gone"
KEYS = "keys"
CHECKPOINT = 16
LOG_NAME = re.compile(r"\d{20}\.json")
#: Values written into a filter; more are joined.
MOST_LITERALS = 1000


class Conflict(RuntimeError):
    """Another writer took the version."""


class Files:
    """The few file operations that tables need, by Hadoop."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def list(self, p: str) -> list[tuple[str, bool]]:
        """(name, is a folder), sorted."""
        if not self.exists(p):
            return []
        return sorted((s.getPath().getName(), s.isDirectory()) for s in self.fs.listStatus(self.path(p)))

    def files(self, p: str, suffix: str) -> list[str]:
        """Files below ``p``, relative to it."""
        out, todo = [], [""]
        while todo:
            at = todo.pop()
            for name, folder in self.list(f"{p}/{at}" if at else p):
                own = f"{at}/{name}" if at else name
                if folder:
                    todo.append(own)
                elif name.endswith(suffix):
                    out.append(own)
        return sorted(out)

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, p: str, text: str) -> None:
        stream = self.fs.create(self.path(p), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def commit(self, p: str, text: str) -> None:
        """Write beside, then put in place: fails if ``p`` exists."""
        beside = f"{p}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(beside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not (self._link(beside, p) if self.fs.getScheme() == "file" else self._rename(beside, p)):
            self.fs.delete(self.path(beside), False)
            raise Conflict(p)

    def _link(self, beside: str, p: str) -> bool:
        nio = self.jvm.java.nio.file
        at = [nio.Path.of(self.fs.makeQualified(self.path(x)).toUri()) for x in (p, beside)]
        try:
            nio.Files.createLink(*at)
        except Py4JJavaError:
            return False
        self.fs.delete(self.path(beside), False)
        return True

    def _rename(self, beside: str, p: str) -> bool:
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.path(beside), self.path(p), none)  # atomic where the store's is
        except Py4JJavaError:
            return False
        return True


class VersionedTable:
    """``merge``: upserts and deletes mark old rows in deletion vectors; without it they rewrite the files that hold such rows. ``stats``: columns whose bounds go into the log
    (the keys by default; None: nothing about the files, which saves reading them); ``bloom``: columns with a Bloom filter per file.
    """

    def __init__(
        self, spark: SparkSession, path: str, keys: list[str] | None = None, buckets: int = 1, by: list[str] | None = None, merge: bool = True,
        stats: list[str] | str | None = KEYS, bloom: list[str] | None = None, codec: str = "snappy",
    ):
        self.spark, self.root, self.keys, self.buckets, self.merge = spark, path.rstrip("/"), list(keys or []), buckets, merge
        self.by = list(by or self.keys)
        self.stats, self.bloom = self.keys if stats is KEYS else stats, list(bloom or [])
        self.codec, self.store = codec, Files(spark, self.root)

    # -- reading

    def exists(self) -> bool:
        return self.version() >= 0

    def version(self) -> int:
        """The latest version, -1 if there is none."""
        return max((int(n[:20]) for n, _ in self.store.list(f"{self.root}/_log") if LOG_NAME.fullmatch(n)), default=-1)

    def entry(self, version: int) -> dict:
        return json.loads(self.store.read(f"{self.root}/_log/{version:020}.json"))

    def state(self, version: int | None = None) -> dict:
        """After a version: files; schema (JSON, or None); marks (by stream, the last number); info (of files: rows, bounds); vectors (of files with rows that are gone: the
        write that holds their bitmaps, rows gone, bitmaps).
        """
        version = self.version() if version is None else version
        at = version // CHECKPOINT * CHECKPOINT
        out, first = {"files": [], "schema": None, "marks": {}, "info": {}, "vectors": {}}, 0
        if at and self.store.exists(f"{self.root}/_log/{at:020}.state.json"):
            out, first = out | json.loads(self.store.read(f"{self.root}/_log/{at:020}.state.json")), at + 1
        for v in range(first, version + 1):
            out = self._after(out, self.entry(v))
        return out

    @staticmethod
    def _after(state: dict, e: dict) -> dict:
        files, info, vectors, marks = dict.fromkeys(state["files"]), dict(state["info"]), dict(state["vectors"]), dict(state["marks"])
        for f in e["remove"]:
            for held in (files, info, vectors):
                held.pop(f, None)
        files |= dict.fromkeys(e["add"])
        info |= e.get("info", {})
        vectors |= e.get("vectors", {})
        vectors = {f: v for f, v in vectors.items() if v}
        if e.get("mark") is not None:
            stream, number = split_mark(e["mark"])
            marks[stream] = max(number, marks.get(stream, -1))
        return {"files": list(files), "schema": e["schema"], "marks": marks, "info": info, "vectors": vectors}

    def live(self, version: int | None = None) -> tuple[list[str], T.StructType | None]:
        s = self.state(version)
        return s["files"], schema_of(s)

    def _paths(self, files: list[str]) -> list[str]:
        return [f"{self.root}/{f}" for f in files]

    def _read(self, files: list[str], schema: T.StructType) -> DataFrame:
        """All rows of these files, gone or not."""
        return self.spark.read.schema(schema).parquet(*self._paths(files)) if files else self.spark.createDataFrame([], schema)

    def _located(self, files: list[str], schema: T.StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema).withColumns({FILE: F.lit(""), ROW: F.lit(0).cast("long")})
        return deletion.located(self.spark, self._paths(files), schema)

    def _bits(self, vectors: dict) -> DataFrame:
        """The bitmaps that hold for these files now."""
        if not vectors:
            return self.spark.createDataFrame([], deletion.SCHEMA).drop("dv")
        now = self.spark.createDataFrame([(tail(f), v["dv"]) for f, v in vectors.items()], "file string, dv string")  # a row per file
        held = self.spark.read.schema(deletion.SCHEMA).parquet(*[f"{self.root}/deletes/{d}" for d in sorted({v["dv"] for v in vectors.values()})])
        return held.join(F.broadcast(now), ["file", "dv"], "left_semi").drop("dv")

    def _rows(self, state: dict, files: list[str] | None = None, located: bool = False) -> DataFrame:
        """The rows of a state (of some of its files) that are not gone."""
        files, schema = state["files"] if files is None else files, schema_of(state)
        read = self._located if located else self._read
        vectors = {f: state["vectors"][f] for f in files if f in state["vectors"]}
        if not vectors:
            return read(files, schema)
        left = [f for f in files if f not in vectors]
        marked = deletion.flagged(self._located(list(vectors), schema), self._bits(vectors), GONE, sent(vectors)).filter(~F.col(GONE)).drop(GONE)
        marked = marked if located else marked.drop(FILE, ROW)
        return read(left, schema).unionByName(marked) if left else marked

    def read(self, version: int | None = None, schema: T.StructType | None = None) -> DataFrame:
        """The rows of a version; a table that doesn't exist has no rows (of the schema given)."""
        state = self.state(version)
        return self._rows(state) if state["schema"] is not None else self._read([], schema or T.StructType())

    def read_files(self, files: list[str]) -> DataFrame:
        """The rows of some of the live files."""
        return self._rows(self.state(), files)

    def read_of(self, values: list[str], version: int | None = None) -> DataFrame:
        """The rows whose (single, text) bucket column has one of these values: of its buckets' files only, by a filter that reaches the scan while it is short."""
        state = self.state(version)
        if state["schema"] is None:
            return self._read([], T.StructType())
        files = state["files"]
        if self.buckets > 1:
            held = {bucket_number(v, self.buckets) for v in values}
            files = [f for f in files if bucket_of(f) is None or bucket_of(f) in held]
        rows, column = self._rows(state, files), F.col(self.by[0])
        if len(values) <= MOST_LITERALS:
            return rows.filter(column.isin(list(values)))
        return rows.join(F.broadcast(self.spark.createDataFrame([(v,) for v in values], f"{self.by[0]} string")), self.by[0], "left_semi")

    def files_for(self, conditions: list[tuple[str, str, object]], version: int | None = None) -> list[str]:
        """The files that can hold rows with all ``conditions`` (column, one of = < <= > >= in null, value): by the bounds in the log, then by Bloom filters."""
        state = self.state(version)
        schema = schema_of(state)
        files = [f for f in state["files"] if f not in state["info"] or all(file_stats.may_hold(state["info"][f], c, op, v, schema[c].dataType) for c, op, v in conditions)]
        for column, op, value in conditions:
            filtered = {f: state["info"][f]["bloom"] for f in files if column in state["info"].get(f, {}).get("bloomed", [])}
            values = [value] if op == "=" else list(value) if op == "in" else []
            if filtered and values and len(values) <= MOST_LITERALS:
                blooms = self.spark.read.schema(file_stats.SCHEMA).parquet(*[f"{self.root}/blooms/{b}" for b in sorted(set(filtered.values()))])
                named = self.spark.range(1).select(*[file_stats.plain(F.lit(v).cast(schema[column].dataType), schema[column].dataType).alias(f"v{k}") for k, v in enumerate(values)]).first()
                hit = file_stats.holding(self.spark, blooms, column, list(named))
                files = [f for f in files if f not in filtered or tail(f) in hit]
        return files

    def scan(self, conditions: list[tuple[str, str, object]], version: int | None = None) -> DataFrame:
        """The rows with all ``conditions``, from the files that can have such."""
        state = self.state(version)
        rows = self._rows(state, self.files_for(conditions, version))
        for column, op, value in conditions:
            kind, c = rows.schema[column].dataType, F.col(column)
            lit = lambda v, kind=kind: F.lit(v).cast(kind)
            rows = rows.filter(
                c.isNull() if op == "null" else c.isin([lit(v) for v in value]) if op == "in"
                else {"=": c.__eq__, "<": c.__lt__, "<=": c.__le__, ">": c.__gt__, ">=": c.__ge__}[op](lit(value))
            )
        return rows

    # -- changes

    def changes_since(self, version: int) -> list[tuple[int, DataFrame]]:
        """(version, rows of the files it added) for each later version that added any."""
        out = []
        for v in range(version + 1, self.version() + 1):
            e = self.entry(v)
            if e["add"]:
                out.append((v, self._read(e["add"], T.StructType.fromJson(e["schema"]))))
        return out

    def changes(self, version: int) -> DataFrame | None:
        """The same as one frame with column ``_version``."""
        parts = [df.withColumn("_version", F.lit(v).cast("long")) for v, df in self.changes_since(version)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def _sides(self, before: dict, after: dict) -> tuple[DataFrame, DataFrame]:
        """(rows only before, rows only after), from files and bitmaps that differ; a row that files on both sides hold is in both."""
        schema, old, new = schema_of(after), set(before["files"]), set(after["files"])
        came = self._rows(after, sorted(new - old))
        gone = self._rows(before | {"schema": after["schema"]}, sorted(old - new))
        marked = {f: v for f, v in after["vectors"].items() if f in old and v != before["vectors"].get(f)}
        if marked:
            earlier = {f: before["vectors"][f] for f in marked if f in before["vectors"]}
            rows = deletion.flagged(self._located(sorted(marked), schema), self._bits(marked), GONE, sent(marked)).filter(GONE).drop(GONE)
            if earlier:
                rows = deletion.flagged(rows, self._bits(earlier), GONE, sent(earlier)).filter(~F.col(GONE)).drop(GONE)
            gone = gone.unionByName(rows.drop(FILE, ROW))
        return gone, came

    def net_changes(self, version: int) -> DataFrame:
        """Rows that are new, different or gone since ``version``, with ``_change``: insert, update or delete (the row as it was); see ``changes.difference``.

        Only files added or removed in between are read, and of files that lost rows those rows' files.
        """
        after = self.state()
        if after["schema"] is None:
            return self.spark.createDataFrame([], T.StructType([T.StructField("_change", T.StringType())]))
        return difference(*self._sides(self.state(version), after), self.keys, schema_of(after))

    def row_changes(self, version: int) -> DataFrame:
        """What one commit changed, likewise."""
        after = self.state(version)
        if self.entry(version).get("same"):
            return self.read(version).limit(0).withColumn("_change", F.lit(""))
        return difference(*self._sides(self.state(version - 1), after), self.keys, schema_of(after))

    def feed(self, after: int, upto: int | None = None) -> DataFrame | None:
        """The changes of every commit after a version, with ``_version``."""
        upto = self.version() if upto is None else upto
        parts = [self.row_changes(v).withColumn("_version", F.lit(v).cast("long")) for v in range(after + 1, upto + 1)]
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else None

    # -- writing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.by]), F.lit(self.buckets)).cast("int")

    def _write_files(self, df: DataFrame, dealt: bool = True) -> list[str]:
        """Without ``dealt`` no row leaves its task: each task writes a file for every bucket it has rows of."""
        folder = f"data/{uuid.uuid4().hex}"
        with swept(self.spark):
            if self.keys and self.buckets > 1:
                cut = df.withColumn(BUCKET, self._bucket())
                cut = cut.hint("rebalance", BUCKET) if dealt else cut
                cut.sortWithinPartitions(BUCKET, *dict.fromkeys([*self.by, *self.keys])).write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}", compression=self.codec)
            else:
                df.write.parquet(f"{self.root}/{folder}", compression=self.codec)
        return [f"{folder}/{f}" for f in self.store.files(f"{self.root}/{folder}", ".parquet")]

    def _describe(self, files: list[str], schema: T.StructType) -> dict[str, dict]:
        """By file: rows, bounds, Bloom filter; only the columns asked for are read again."""
        columns = [c for c in dict.fromkeys(self.stats or []) if c in schema.names]
        if not files or self.stats is None:
            return {}
        rows = self._located(files, schema)
        found = file_stats.collect(rows, columns)
        bloomed = [c for c in self.bloom if c in schema.names]
        extra = {}
        if bloomed:
            extra = {"bloom": uuid.uuid4().hex, "bloomed": bloomed}
            file_stats.build(rows, bloomed).write.parquet(f"{self.root}/blooms/{extra['bloom']}")
        none = {"rows": 0, "columns": {c: [None, None, 0] for c in columns}}
        return {f: found.get(tail(f), none) | extra for f in files}

    def _mark(self, state: dict, places: DataFrame) -> tuple[dict, list[str]]:
        """``places``: _file, _row of rows to be marked. (vectors of the files that have such, files without any row left)."""
        dv, names = uuid.uuid4().hex, {tail(f): f for f in state["files"]}
        new = deletion.bitmaps(places)
        if state["vectors"]:
            held = self._bits(state["vectors"]).join(places.select(F.col(FILE).alias("file")).distinct(), "file", "left_semi")
            new = deletion.united(new, held)
        path = f"{self.root}/deletes/{dv}"
        new.withColumn("dv", F.lit(dv)).write.parquet(path)
        held = self.spark.read.schema(deletion.SCHEMA).parquet(path)
        sums = held.groupBy("file").agg(F.sum(F.bitmap_count("bits")).alias("gone"), F.count(F.lit(1)).alias("blocks")).collect()  # a row per file
        vectors = {names[r["file"]]: {"dv": dv, "gone": r["gone"], "blocks": r["blocks"]} for r in sums}
        empty = [f for f, v in vectors.items() if v["gone"] == state["info"].get(f, {}).get("rows")]
        return {f: v for f, v in vectors.items() if f not in empty}, empty

    def _commit(
        self, version: int, add: list[str], remove: list[str], schema: T.StructType, mark: str | None = None, vectors: dict | None = None, same: bool = False, own: bool = True
    ) -> int:
        """The files of a commit that lost the race are deleted if they are its ``own``."""
        e = {
            "version": version, "add": add, "remove": remove, "schema": json.loads(schema.json()), "time": time.time(), "mark": mark,
            "vectors": vectors or {}, "info": self._describe(add, schema), "same": same,
        }
        try:
            self.store.commit(f"{self.root}/_log/{version:020}.json", json.dumps(e))
        except Conflict:
            if own:
                self._drop(e)
            raise
        if version and version % CHECKPOINT == 0:
            with suppress(Conflict):  # only a shorter way to what the log says
                self.store.commit(f"{self.root}/_log/{version:020}.state.json", json.dumps(self.state(version)))
        return version

    def _drop(self, e: dict) -> None:
        for folder in {f"{self.root}/{'/'.join(f.split('/')[:2])}" for f in e["add"]} | {f"{self.root}/deletes/{v['dv']}" for v in e["vectors"].values() if v}:
            self.store.fs.delete(self.store.path(folder), True)
        for bloom in {i["bloom"] for i in e["info"].values() if "bloom" in i}:
            self.store.fs.delete(self.store.path(f"{self.root}/blooms/{bloom}"), True)

    def done(self, mark: str) -> bool:
        """Whether a commit with this mark, or a later one of its stream, is in the log."""
        stream, number = split_mark(mark)
        return self.state()["marks"].get(stream, -1) >= number

    def write(self, df: DataFrame, mark: str | None = None, nothing: bool = False, dealt: bool = True) -> int:
        """Create, append or upsert, whichever the table and its keys ask for; ``nothing``: the caller knows there are no rows; not ``dealt``: rows come in few tasks and are
        written by those, without a shuffle by bucket."""
        if nothing:
            return self.version()
        if not self.exists():
            return self._commit(0, self._write_files(df, dealt), [], nullable(df.schema), mark)
        return self._merge(df, None, mark, dealt) if self.keys else self.append(df, mark)

    def added(self, version: int) -> DataFrame:
        """The rows that a commit wrote, gone since or not."""
        e = self.entry(version)
        return self._read(e["add"], T.StructType.fromJson(e["schema"]))

    def append(self, df: DataFrame, mark: str | None = None) -> int:
        version = self.version()
        _, schema = self.live(version)
        return self._commit(version + 1, self._write_files(df.select(*schema.names)), [], schema, mark)

    def upsert(self, df: DataFrame, mark: str | None = None) -> int:
        """New rows replace rows with their keys as a whole. Null keys match nothing; rows that share a key within ``df`` all stay. ``df`` is computed once: its files are written
        first, and its keys are read from them."""
        return self._merge(df, None, mark)

    def apply(self, changes: DataFrame, mark: str | None = None) -> int:
        """Rows with ``_change``, one per key: deletes go, others replace the rows with their keys, in one commit. ``changes`` is computed twice."""
        rows = changes.filter("_change <> 'delete'").drop("_change")
        if not self.exists():
            return self.write(rows, mark)
        return self._merge(rows, changes.filter("_change = 'delete'").select(*self.keys), mark)

    def _merge(self, df: DataFrame, gone: DataFrame | None, mark: str | None, dealt: bool = True) -> int:
        version = self.version()
        state = self.state(version)
        schema = schema_of(state)
        add = self._write_files(df.select(*schema.names), dealt)
        keys = self._read(add, schema).select(*self.keys)
        touched = state["files"]
        if self.buckets > 1 and gone is None:
            held = {bucket_of(f) for f in add}
            touched = [f for f in touched if bucket_of(f) is None or bucket_of(f) in held]
        keys = (keys if gone is None else keys.unionByName(gone)).distinct()
        if not self.merge:
            kept = self._rows(state, touched).join(keys, self.keys, "left_anti").select(*schema.names)
            return self._commit(version + 1, add + self._write_files(kept), touched, schema, mark)
        places = self._rows(state, touched, located=True).join(keys, self.keys, "left_semi").select(FILE, ROW)
        vectors, empty = self._mark(state, places)
        return self._commit(version + 1, add, empty, schema, mark, vectors)

    def swap(self, df: DataFrame, files: list[str]) -> list[str]:
        """These rows in place of some of the live files, in one commit; returns the new files."""
        version = self.version()
        schema = schema_of(self.state(version)) if version >= 0 else nullable(df.schema)
        add = self._write_files(df.select(*schema.names))
        self._commit(version + 1, add, files, schema)
        return add

    def replace(self, df: DataFrame) -> int:
        """These rows and no others, in one commit."""
        version = self.version()
        files, schema = self.live(version)
        schema = nullable(df.schema) if schema is None else schema
        return self._commit(version + 1, self._write_files(df.select(*schema.names)), files, schema)

    def _take_out(self, version: int, state: dict, places: DataFrame, mark: str | None = None) -> int:
        """Rows marked, or their files written again without them."""
        vectors, empty = self._mark(state, places)
        if not vectors and not empty:
            return version
        if self.merge:
            return self._commit(version + 1, [], empty, schema_of(state), mark, vectors)
        after = state | {"vectors": state["vectors"] | vectors}
        return self._commit(version + 1, self._write_files(self._rows(after, list(vectors))), [*vectors, *empty], schema_of(state), mark)

    def delete(self, condition: Column) -> int:
        version = self.version()
        state = self.state(version)
        return self._take_out(version, state, self._rows(state, located=True).filter(condition).select(FILE, ROW))

    def delete_matching(self, values: DataFrame, columns: list[str]) -> int:
        """Delete rows in which one of ``columns`` has a value of ``values`` (its first column)."""
        version = self.version()
        state = self.state(version)
        named = values.select(F.col(values.columns[0]).alias("_value")).distinct()
        held = self._rows(state, located=True).select(FILE, ROW, F.explode(F.array(*columns)).alias("_value"))
        return self._take_out(version, state, held.join(named, "_value", "left_semi").select(FILE, ROW))

    def restore(self, version: int) -> int:
        """The rows of an earlier version again, by a commit that takes its files and marks back; nothing is written but the log."""
        now, then = self.state(), self.state(version)
        add, remove = sorted(set(then["files"]) - set(now["files"])), sorted(set(now["files"]) - set(then["files"]))
        marks = {f: then["vectors"].get(f) for f in then["files"] if f in add or then["vectors"].get(f) != now["vectors"].get(f)}
        if not (add or remove or marks):
            return self.version()
        return self._commit(self.version() + 1, add, remove, schema_of(then) or schema_of(now), vectors={f: v for f, v in marks.items() if v or f in now["vectors"]}, own=False)

    def compact(self, share: float = 0.0) -> int:
        """Write the files anew that have lost more than ``share`` of their rows, without those. No row changes, so change feeds pass over it."""
        version = self.version()
        state = self.state(version)
        files = [f for f, v in state["vectors"].items() if v["gone"] > share * state["info"].get(f, {}).get("rows", 0)]
        if not files:
            return version
        return self._commit(version + 1, self._write_files(self._rows(state, files)), files, schema_of(state), same=True)


def schema_of(state: dict) -> T.StructType | None:
    return state["schema"] and T.StructType.fromJson(state["schema"])


def sent(vectors: dict) -> bool:
    """Whether so many bitmaps may go to every executor."""
    return sum(v["blocks"] for v in vectors.values()) <= deletion.MOST_SENT


def bucket_of(file: str) -> int | None:
    for part in file.split("/"):
        if part.startswith(f"{BUCKET}="):
            return int(part.split("=")[1])
    return None


def tail(path: str) -> str:
    """What tells files of one table apart; buckets have files of the same name."""
    return "/".join(path.rsplit("/", 3)[-3:])


def split_mark(mark: str) -> tuple[str, int]:
    """A mark is ``stream#number``; one without a number is a stream of its own."""
    stream, _, number = mark.rpartition("#")
    return (stream, int(number)) if stream and number.isdigit() else (mark, 0)


def bucket_number(value: str, buckets: int) -> int:
    """What ``pmod(xxhash64(value), buckets)`` gives in a plan."""
    h = xxhash.xxh64_intdigest(value.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last by ``order``; rows with null keys all stay, and stay where they are."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.filter(known).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").unionByName(df.filter(~known))


class Lake:
    """Tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = Files(spark, self.root)

    def table(self, name: str, keys: list[str] | None = None, buckets: int = 1, by: list[str] | None = None, **options) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}", keys, buckets, by, **options)

    def open(self, name: str) -> VersionedTable | None:
        t = self.table(name)
        return t if t.exists() else None

    def walk(self, prefix: str = "") -> Iterator[str]:
        todo = [prefix.strip("/")]
        while todo:
            at = todo.pop()
            names = [n for n, folder in self.store.list(f"{self.root}/{at}" if at else self.root) if folder]
            if "_log" in names:
                yield at
            else:
                todo += [f"{at}/{n}" if at else n for n in names]

    def list_tables(self, prefix: str = "") -> list[tuple[str, list[tuple[str, str, bool]]]]:
        """(path, columns by name), by path; tables that can't be read are left out."""
        out = []
        for name in sorted(self.walk(prefix)):
            _, schema = self.table(name).live()
            if schema is not None:
                out.append((name, sorted((f.name, f.dataType.simpleString(), f.nullable) for f in schema.fields)))
        return out

    def types_below(self, folder: str) -> list[str]:
        """Sub-folders: edge types of ``silver/edges``, indexed types of ``silver/index``."""
        return [n for n, is_folder in self.store.list(f"{self.root}/{folder}") if is_folder]
