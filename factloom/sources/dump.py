"""Points-to solutions as a byte stream: the Spark data source `solution`, and its reader and writer.

The stream holds one set for each slot, in slot order. An object is written in groups of 7 bits, lowest first, and ended by
the byte 254 (object 0 is that byte alone); between two sets lies the byte 255. A dump is one such file, or a folder of parts: the stream is then the parts in the
order of their names, joined by 255. An empty stream is one empty set.

Files are opened through pyarrow, by a path or by the address of a store that it knows, and must be within reach of all executors.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from factloom.operators.fixpoint import settle

#: Fixed values of the format.
END_OF_OBJECT, END_OF_SET = 254, 255
#: Bytes that a task reads at once, and of a file that one task reads.
CHUNK, SPLIT = 1 << 20, 64 << 20


def encode(objs: np.ndarray, ends: np.ndarray) -> bytes:
    """Sets that lie one after the other in `objs`, up to `ends` each, as a stream."""
    objs, ends = np.asarray(objs, np.int64), np.asarray(ends, np.int64)
    if len(objs) and objs.min() < 0:
        raise ValueError("objects are numbers from 0")
    digits = np.zeros(len(objs), np.int64)
    rest = objs.copy()
    while rest.any():
        digits += rest > 0
        rest >>= 7
    before = np.searchsorted(ends, np.arange(len(objs)), side="right")  # sets that end before an object
    start = np.cumsum(digits + 1) - digits - 1 + before
    size = int((digits + 1).sum()) + max(len(ends) - 1, 0)
    out = np.full(size, END_OF_SET, np.uint8)
    out[start + digits] = END_OF_OBJECT
    for k in range(int(digits.max(initial=0))):
        has = digits > k
        out[start[has] + k] = (objs[has] >> (7 * k)) & 127
    return out.tobytes()


def decode(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Objects that end in a piece of a stream, whose first byte begins an object or a set, and how many sets end before each."""
    stops = np.flatnonzero(piece == END_OF_OBJECT)
    marks = np.flatnonzero(piece >= END_OF_OBJECT)
    begins = np.concatenate([[0], marks + 1])[np.searchsorted(marks, stops)]
    length = stops - begins
    objs = np.zeros(len(stops), np.int64)
    for k in range(int(length.max(initial=0))):
        has = length > k
        objs[has] |= piece[begins[has] + k].astype(np.int64) << (7 * k)
    return objs, np.cumsum(piece == END_OF_SET)[stops] if len(stops) else stops


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


@dataclass
class Split(InputPartition):
    """The sets that a file's bytes from `lo` to `hi` begin: those after a separator in there, and the first set of the file."""

    path: str
    part: int
    split: int
    lo: int
    hi: int


class SolutionReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Split]:
        store, root = _open(self.path)
        info = store.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info]
        if info.type == pafs.FileType.Directory:
            files = sorted((f for f in store.get_file_info(pafs.FileSelector(root)) if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)
        return [Split(f.path, n, i, lo, min(lo + self.size, f.size)) for n, f in enumerate(files) for i, lo in enumerate(range(0, max(f.size, 1), self.size))]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        names = ["part", "split", "nth", "obj"]

        def batch(nth: np.ndarray, objs: np.ndarray, empty: np.ndarray) -> pa.RecordBatch:
            """Rows of objects, and a row without one for each set number in `empty`."""
            n = len(nth) + len(empty)
            ids = [pa.array(np.full(n, x, np.int32)) for x in (partition.part, partition.split)]
            return pa.RecordBatch.from_arrays([*ids, pa.array(np.concatenate([nth, empty]).astype(np.int64)), pa.concat_arrays([pa.array(objs, pa.int64()), pa.nulls(len(empty), pa.int64())])], names)

        with store.open_input_file(partition.path) as file:
            file.seek(partition.lo)
            at, nth, kept = partition.lo, 0 if partition.lo == 0 else -1, b""  # nth: the set that is being read, of those that begin here
            if nth == 0:
                yield batch(*np.split(np.zeros(1, np.int64), [0, 0]))
            while True:
                data = file.read(CHUNK)
                stream = np.frombuffer(data, np.uint8)
                ends = np.flatnonzero(stream == END_OF_SET)
                beyond = ends[at + ends >= partition.hi]
                last = len(beyond) > 0  # a separator past the split ends its last set
                if last:
                    stream, ends = stream[: beyond[0]], ends[at + ends < partition.hi]
                at += len(data)
                whole = np.concatenate([np.frombuffer(kept, np.uint8), stream])
                cut = np.flatnonzero(whole >= END_OF_OBJECT)
                cut = cut[-1] + 1 if len(cut) else 0
                objs, sets = decode(whole[:cut])
                own = sets + nth >= 0
                yield batch((sets + nth)[own], objs[own], np.arange(nth + 1, nth + 1 + len(ends)))
                nth, kept = nth + len(ends), whole[cut:].tobytes()
                if last or not data or (nth < 0 and at >= partition.hi):
                    return


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class SolutionWriter(DataSourceArrowWriter):
    """Tasks write parts into a folder of this job, which become the dump when all are there."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        name, out, last = None, None, -1
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                locs = batch.column(batch.schema.get_field_index("loc")).to_numpy(zero_copy_only=False)
                if locs[0] <= last or (np.diff(locs) != 1).any() or (out is not None and locs[0] != last + 1):
                    raise ValueError("slots of a task must follow each other without gaps")
                sets = batch.column(batch.schema.get_field_index("objs"))
                ends = np.cumsum(sets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                if out is None:
                    store.create_dir(posixpath.join(root, self.job), recursive=True)
                    name = f"part-{locs[0]:019d}-{uuid.uuid4().hex}"  # attempts of one task don't meet
                    out = store.open_output_stream(posixpath.join(root, self.job, name))
                else:
                    out.write(bytes([END_OF_SET]))
                out.write(encode(sets.flatten().to_numpy(zero_copy_only=False), ends))
                last = int(locs[-1])
        finally:
            if out is not None:
                out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        old = [f for f in store.get_file_info(pafs.FileSelector(root)) if f.is_file]
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        for f in old:
            store.delete_file(f.path)
        for m in messages:
            if m is not None and m.name is not None:
                store.move(posixpath.join(root, self.job, m.name), posixpath.join(root, m.name))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        if store.get_file_info(posixpath.join(root, self.job)).type == pafs.FileType.Directory:
            store.delete_dir(posixpath.join(root, self.job))


class SolutionSource(DataSource):
    """Rows part, split, nth (of the sets that begin there), obj; a set also has a row without an object. Written from loc and objs. Option splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "solution"

    def schema(self) -> str:
        return "part int, split int, nth long, obj long"

    def reader(self, schema) -> SolutionReader:
        return SolutionReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))

    def writer(self, schema, overwrite: bool) -> SolutionWriter:
        return SolutionWriter(self.options["path"], overwrite)


def write_dump(pts: DataFrame, slots: int, path: str, parts: int | None = None) -> None:
    """Sets of pts(loc, obj) for all slots below `slots`, at least one, as a dump in `path`, which it replaces. Repeated rows count once; rows without a slot or an object, or of other slots, are left out.

    Slots are dealt to tasks in ranges, `parts` of them or as many as Spark finds right, so a task's part holds slots that follow each other; a set is one row."""
    spark = pts.sparkSession
    spark.dataSource.register(SolutionSource)
    sets = pts.filter(f"loc is not null and obj is not null and loc between 0 and {slots - 1}").groupBy("loc").agg(F.array_sort(F.collect_set(F.col("obj").cast("long"))).alias("objs"))
    out = spark.range(slots).toDF("loc").join(sets, "loc", "left").select("loc", F.coalesce("objs", F.array().cast("array<long>")).alias("objs"))
    out = out.repartitionByRange("loc") if parts is None else out.repartitionByRange(parts, "loc")
    out.sortWithinPartitions("loc").write.format("solution").mode("overwrite").save(path)


def read_dump(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """loc, obj of a dump, with a row without an object for each slot that has an empty set. Parts of a file are read by tasks of their own, so a
    slot's number is counted: sets before its split, and before it in there. The running sum goes over one row for each split."""
    spark.dataSource.register(SolutionSource)
    rows = settle(spark.read.format("solution").option("splitBytes", split_bytes).load(path))
    before = Window.orderBy("part", "split").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part", "split").agg((F.max("nth") + 1).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "split", "first")
    placed = rows.join(F.broadcast(starts), ["part", "split"]).select((F.col("first") + F.col("nth")).alias("loc"), "obj")
    filled = placed.filter("obj is not null")
    return filled.union(placed.filter("obj is null").join(filled.select("loc").distinct(), "loc", "left_anti"))
