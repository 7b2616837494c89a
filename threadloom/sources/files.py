"""Files under names of their own, and one document of ordered parts, written by many tasks.

Folders must be such that all executors see them: a mounted path, or a store that pyarrow knows by its address.
"""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.store import kept


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of an address and the path in it."""
    if uri.startswith("file:/"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri)


class NamedFilesWriter(DataSourceWriter):
    """A task writes its files to a folder of its attempt and moves each to its name once all are there; a move is atomic, and
    an attempt that fails leaves nothing under a name. A retried task moves the same files again."""

    def __init__(self, path: str):
        self.path, self.staging = path, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> WriterCommitMessage:
        fs, root = filesystem(self.path)
        attempt = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        fs.create_dir(attempt)
        names: dict[str, str] = {}
        for i, row in enumerate(iterator):
            with fs.open_output_stream(f"{attempt}/{i}") as out:
                out.write((row.document or "").encode())
            names[f"{row.folder}/{row.name}"] = f"{attempt}/{i}"
        for folder in {n.rpartition("/")[0] for n in names}:
            fs.create_dir(f"{root}/{folder}")
        for name, at in names.items():
            fs.move(at, f"{root}/{name}")
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(f"{root}/{self.staging}")
        fs.delete_dir(f"{root}/{self.staging}")
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(f"{root}/{self.staging}")
        fs.delete_dir(f"{root}/{self.staging}")


class NamedFiles(DataSource):
    """Rows (folder, name, document) as UTF-8 files ``path``/folder/name."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "folder string, name string, document string"

    def writer(self, schema, overwrite) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"])


def write_named(rows: DataFrame, path: str, order: list[str]) -> None:
    """Rows with folder, name, document. Of rows with one name the last by ``order`` stays, as they come to one task."""
    rows.sparkSession.dataSource.register(NamedFiles)
    placed = rows.repartition("folder", "name").sortWithinPartitions("folder", "name", *order)
    placed.select("folder", "name", "document").write.format("named_files").option("path", path).mode("append").save()


def write_document(lines: DataFrame, order: list[str], path: str) -> int:
    """One file of the rows' ``value``, a line each, in a total order; returns its bytes.

    Rows are sorted in range partitions. Their sizes tell where each part begins, so every task writes its own stretch of one file,
    which gets its name when all are there and add up; on stores whose files can't be written in the middle, parts are
    files that one task then joins, a few megabytes at a time."""
    part, row = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")
    placed = kept(lines.repartitionByRange(*order).sortWithinPartitions(*order).select(F.coalesce("value", F.lit("")).alias("value"), part, row))
    sizes = placed.groupBy("_part").agg(F.sum(F.octet_length("value") + 1).cast("long").alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_at")
    offsets = kept(sizes.select("_part", before, "bytes"))
    total = offsets.agg(F.sum("bytes")).first()[0] or 0
    fs, target = filesystem(path)
    fs.create_dir(target.rpartition("/")[0])
    local, temp = isinstance(fs, pa.fs.LocalFileSystem), f"{target}.{uuid.uuid4().hex}.tmp"
    if local:
        with open(temp, "wb") as f:
            f.truncate(total)

    def write(batches):
        at = out = None
        written, number = 0, -1
        for batch in batches:
            for value, this, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if this != number:
                    if out is not None:
                        out.close()
                    number, at = this, start
                    if local:
                        out = open(temp, "r+b", buffering=1 << 20)  # noqa: SIM115  closed below
                        out.seek(at)
                    else:
                        out = fs.open_output_stream(f"{temp}.{number}")
                raw = value.encode() + b"\n"
                out.write(raw)
                written += len(raw)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"bytes": pa.array([written], pa.int64())})

    # A part is one task's, in order.
    dealt = placed.join(F.broadcast(offsets.select("_part", "_at")), "_part").repartition("_part").sortWithinPartitions("_part", "_row")
    done = kept(dealt.select("value", "_part", "_at").mapInArrow(write, "bytes long")).agg(F.sum("bytes")).first()[0] or 0
    if done != total:
        raise OSError(f"{path}: {done} of {total} bytes were written")
    if not local:
        with fs.open_output_stream(temp) as out:
            for r in sorted(x._part for x in offsets.select("_part").collect()):
                with fs.open_input_stream(f"{temp}.{r}") as f:
                    while block := f.read(8 << 20):
                        out.write(block)
                fs.delete_file(f"{temp}.{r}")
    os.replace(temp, target) if local else fs.move(temp, target)
    return total


def json_document(sections: dict[str, DataFrame], order: str = "key") -> DataFrame:
    """The lines (value, section, key) of one JSON object with a list a section; a section's rows are (key, value), in order of a unique
    ``key``, and values are JSON. A name with a slash is a list inside an object: ``graph/nodes``."""
    rows, outer, n = [], None, 0
    spark = next(iter(sections.values())).sparkSession
    text = lambda at, value: spark.createDataFrame([(value, at, "")], "value string, section int, key string")
    for k, (name, df) in enumerate(sections.items()):
        parent, _, own = name.rpartition("/")
        closing = "" if outer in (None, parent) or not outer else "}"
        opening = f'"{parent}": {{' if parent and parent != outer else ""
        comma = "," if k and not (parent and parent == outer and opening) else ""
        rows.append(text(n, ("{" if not k else closing + comma) + opening + f'"{own}": ['))
        first = df.agg(F.min(order).alias("first"))
        listed = df.join(F.broadcast(first)).select(F.concat(F.when(F.col(order) == F.col("first"), "").otherwise(","), "value").alias("value"), F.lit(n + 1).alias("section"), F.col(order).cast("string").alias("key"))
        rows += [listed, text(n + 2, "]")]
        outer, n = parent, n + 3
    rows.append(text(n, "}}" if outer else "}"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
