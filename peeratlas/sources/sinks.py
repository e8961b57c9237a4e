"""Files that the map's stages leave: tables, JSON documents, images, binary records."""

import json
import os
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .storage import cut


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path within."""
    if uri.startswith("s3a://"):
        uri = "s3://" + uri[6:]
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    elif uri.startswith("/"):
        uri = "file://" + uri
    return pafs.FileSystem.from_uri(uri)


def write_bytes(uri: str, body: bytes) -> None:
    """Write beside, then rename: readers never see half a file, and a task that is tried
    again replaces it by the same."""
    files, path = filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        out.write(body)
    files.move(part, path)


def write_table(df: DataFrame, out: str) -> int:
    """Replace the table and return its rows; counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(out)
    return seen.get["rows"]


def remove(spark, uri: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(uri)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_json(path: str, document) -> None:
    """One document made on the driver (a bounded one)."""
    write_bytes(path, json.dumps(document, ensure_ascii=False).encode())


def read_json(spark, path: str):
    """A small document, None where there is no file."""
    files, inside = filesystem(path)
    if files.get_file_info(inside).type == pafs.FileType.NotFound:
        return None
    with files.open_input_stream(inside) as body:
        return json.loads(body.read())


def json_bytes(fields: list[str]) -> Column:
    """The length in UTF-8 of an entry as a shard's file holds it, with the comma and the
    blank that part it from the next: texts with their escapes, whole numbers, and doubles
    of 0.001 up to ten million, which all writers spell alike."""
    length = lambda c: F.when(F.col(c).isNull(), 4).otherwise(F.octet_length(F.to_json(F.struct(F.col(c).alias("v")))) - len('{"v":}'))
    total = F.lit(2 * len(fields) + 2)
    for c in fields:
        total = total + length(c)
    return total.cast("long")


def write_json_shards(df: DataFrame, folder: str, keys: list[str], order: list[str], fields: list[str], wrap: str | None = None, named: bool = False, empty: DataFrame | None = None) -> DataFrame:
    """One JSON file per key with its rows in order (ties by the fields), as arrays of the
    fields; returns (path, entries) of the files written. The folder is removed first.

    wrap: the list stands under this name. named: the first field names each entry, so the
    file is a map from it to the other fields (of entries with one name, which must be next
    to each other in this order, the last stands). empty: more keys (key string), whose
    files have no entries unless df has some.

    Rows are dealt by key and sorted; a task streams them into the open file of the key, so
    it holds a batch of rows whatever the size of a shard. A file gets its name when it is
    complete, so a task that is tried again replaces it by the same.
    """
    remove(df.sparkSession, folder)
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    rows = df.select(key.alias("key"), F.lit(True).alias("has"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])
    if empty is not None:
        rows = rows.unionByName(empty.select("key", F.lit(False).alias("has")), allowMissingColumns=True)
    places, values = [f"o{i}" for i in range(len(order))], [f"f{i}" for i in range(len(fields))]
    dealt = rows.repartition("key").sortWithinPartitions("key", "has", *places, *values)
    head, tail = ("{", "}") if named else ('{"%s": [' % wrap, "]}") if wrap else ("[", "]")  # noqa: UP031

    def put(batches):
        shard = None
        for batch in batches:
            done = []
            for name, has, *entry in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "has", *values)), strict=True):
                if shard is None or shard.key != name:
                    if shard is not None:
                        done.append(shard.close())
                    shard = _Shard(name, f"{folder}/{name}.json", head, tail, named)
                if has:
                    shard.add(entry)
            yield _written(done)
        if shard is not None:
            yield _written([shard.close()])

    return dealt.select("key", "has", *values).mapInArrow(put, "path string, entries long")


def _written(done: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "entries"])


class _Shard:
    """The open file of a key; an entry waits for the next one, which may replace it."""

    def __init__(self, key: str, uri: str, head: str, tail: str, named: bool):
        self.key, self.uri, self.tail, self.named = key, uri, tail, named
        self.files, self.path = filesystem(uri)
        self.files.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.files.open_output_stream(self.part)
        self.out.write(head.encode())
        self.entries, self.waiting = 0, None

    def add(self, entry: list) -> None:
        if self.waiting is not None and not (self.named and self.waiting[0] == entry[0]):
            self._write(", ")
        self.waiting = entry

    def _write(self, after: str) -> None:
        text = json.dumps(self.waiting[1:] if self.named else self.waiting, ensure_ascii=False)
        name = json.dumps({self.waiting[0]: 0}, ensure_ascii=False)[1:-2] if self.named else ""
        self.out.write((name + text + after).encode())
        self.entries += 1

    def close(self) -> tuple[str, int]:
        if self.waiting is not None:
            self._write("")
        self.out.write(self.tail.encode())
        self.out.close()
        self.files.move(self.part, self.path)
        return self.uri, self.entries


def write_json_doc(df: DataFrame, path: str, order: list, most_rows: int = 1_000_000) -> int:
    """One JSON document with all rows; for tables with a bound (a row per region or
    community). More rows than most_rows are an error."""
    rows = df.orderBy(*order).limit(most_rows + 1).toJSON().collect()
    if len(rows) > most_rows:
        raise ValueError(f"{path}: more than {most_rows} rows for one document")
    write_bytes(path, ("[" + ",\n".join(rows) + "]").encode())
    return len(rows)


def read_regions(spark, path: str) -> DataFrame:
    """Names of communities from regions.json; no file means no names."""
    schema = "name string, xw double, yw double, spread double, members long, rank int, community long, zmin int, zmax int"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_binary(df: DataFrame, path: str, fields: dict[str, str], row: str = "row", rows_a_part: int = 1 << 20, in_place: bool | None = None) -> DataFrame:
    """One file of fixed-width records in the order of row, a dense number from 0. fields:
    columns and their little-endian formats (u1, u2, u8). Returns (part, records).

    The place of a record follows from its number. Where the file system is a mounted one,
    tasks write their parts of rows_a_part records at their places in one unfinished file
    (in_place; again the same bytes if a task is tried again). Elsewhere parts are files
    that the file system joins itself or, where it can't, that a task streams into one. The
    file gets its name when it is whole and has the right size; a second run replaces it.
    """
    spark = df.sparkSession
    files, inside = filesystem(path)
    in_place = isinstance(files, pafs.LocalFileSystem) if in_place is None else in_place
    unfinished, width = f"{path}.{uuid.uuid4().hex}.part", np.dtype([(c, f"<{kind}") for c, kind in fields.items()]).itemsize
    if in_place:
        write_bytes(unfinished, b"")

    def put(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(row)
        first = int(rows[row].iloc[0])
        part = first // rows_a_part
        records = np.empty(len(rows), [(c, f"<{kind}") for c, kind in fields.items()])
        for c in fields:
            records[c] = rows[c].to_numpy()
        if in_place:
            with open(filesystem(unfinished)[1], "r+b") as out:
                out.seek(first * width)
                out.write(records.tobytes())
        else:
            write_bytes(f"{unfinished}/{part:08d}", records.tobytes())
        return pd.DataFrame([(part, len(rows), int(rows[row].iloc[-1]) + 1 - first)], columns=["part", "records", "span"])

    parts = df.select(row, *fields).withColumn("_part", F.floor(F.col(row) / rows_a_part))
    done = cut(parts.groupBy("_part").applyInPandas(put, "part long, records long, span long"), "binary-parts")
    if not in_place:
        unfinished = _joined(spark, unfinished, path, done.count())
    files, whole = filesystem(unfinished)
    size, (records, span) = files.get_file_info(whole).size, done.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("records", "span")]).first()
    if size != records * width or span != records:
        files.delete_file(whole)
        raise ValueError(f"{path}: {size} bytes for {records} records of {width}; numbers must be dense")
    if files.get_file_info(inside).type == pafs.FileType.Directory:
        remove(spark, path)
    files.move(whole, inside)
    return done.select("part", "records")


def _joined(spark, folder: str, path: str, parts: int) -> str:
    """The files 0 to parts - 1 of a folder as one file beside path: joined by the file
    system if it knows how, else streamed by one task."""
    target = f"{path}.{uuid.uuid4().hex}.whole"
    jvm, names = spark._jvm, [f"{folder}/{n:08d}" for n in range(parts)]
    place = jvm.org.apache.hadoop.fs.Path(target)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    write_bytes(target, b"")
    if not parts:
        return target
    try:
        sources = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, parts)
        for n, name in enumerate(names):
            sources[n] = jvm.org.apache.hadoop.fs.Path(name)
        fs.concat(place, sources)
    except UnsupportedOperationException:

        def copy(batches):
            for _ in batches:
                out_fs, out_path = filesystem(target)
                with out_fs.open_output_stream(out_path) as out:
                    for name in names:
                        in_fs, in_path = filesystem(name)
                        with in_fs.open_input_stream(in_path) as source:
                            while piece := source.read(8 << 20):
                                out.write(piece)
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["done"])

        spark.range(1).repartition(1).mapInArrow(copy, "done long").collect()
    remove(spark, folder)
    return target


def tile_path(folder: str, zoom: int, tx: int, ty: int) -> str:
    return f"{folder}/{zoom}/{tx}/{ty}.png"


def tiles_without_image(tiles: DataFrame, folder: str, zoom: int) -> DataFrame:
    """Those of tiles(tx, ty) that have no image yet: only these need drawing."""

    def look(batches):
        for batch in batches:
            if len(batch):
                places = [filesystem(tile_path(folder, zoom, tx, ty)) for tx, ty in zip(batch["tx"], batch["ty"], strict=True)]
                found = places[0][0].get_file_info([path for _, path in places])
                yield batch[[f.type == pafs.FileType.NotFound for f in found]]

    return tiles.select("tx", "ty").mapInPandas(look, "tx int, ty int")


def write_png_tiles(tiles: DataFrame, folder: str, zoom: int) -> DataFrame:
    """{folder}/{zoom}/{tx}/{ty}.png; tiles that exist are left alone. Returns (path,
    written)."""

    def put(batches):
        for batch in batches:
            out = []
            for tx, ty, png in zip(batch["tx"], batch["ty"], batch["png"], strict=True):
                path = tile_path(folder, zoom, tx, ty)
                files, inside = filesystem(path)
                there = files.get_file_info(inside).type != pafs.FileType.NotFound
                if not there:
                    write_bytes(path, png)
                out.append((path, not there))
            yield pd.DataFrame(out, columns=["path", "written"])

    return tiles.mapInPandas(put, "path string, written boolean")
