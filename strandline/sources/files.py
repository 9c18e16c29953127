"""Files through Hadoop's file systems: text with line numbers, small files, renames."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def _path(spark: SparkSession, uri: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, uri: str) -> bool:
    fs, p = _path(spark, uri)
    return fs.exists(p)


def size(spark: SparkSession, uri: str) -> int:
    fs, p = _path(spark, uri)
    return fs.getFileStatus(p).getLen()


def list_names(spark: SparkSession, uri: str) -> list[str]:
    fs, p = _path(spark, uri)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, uri: str) -> None:
    fs, p = _path(spark, uri)
    fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str, replace: bool = False) -> None:
    """One atomic step; without ``replace`` it fails where the target exists."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    fs, p = _path(spark, source)
    kinds = jvm.org.apache.hadoop.fs.Options.Rename
    options = context._gateway.new_array(kinds, 1 if replace else 0)
    if replace:
        options[0] = kinds.OVERWRITE
    _, to = _path(spark, target)
    fs.mkdirs(to.getParent())
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), context._jsc.hadoopConfiguration()).rename(p, to, options)


def read_bytes(spark: SparkSession, uri: str) -> bytes:
    """A whole small file, by way of the driver."""
    return b"".join(_blocks(spark, uri))


def read_range(spark: SparkSession, uri: str, at: int, n: int) -> bytes:
    """n bytes of a file from a place on, by way of the driver; of a folder, as if its files were one."""
    if is_folder(spark, uri):
        out = b""
        for name in text_parts(spark, uri):
            held = size(spark, f"{uri}/{name}")
            if at < held and n > 0:
                part = read_range(spark, f"{uri}/{name}", at, min(n, held - at))
                out, n, at = out + part, n - len(part), held
            at -= held
        return out
    fs, p = _path(spark, uri)
    stream, io = fs.open(p), spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    stream.seek(at)
    data = bytes(io.toByteArray(stream, n))
    stream.close()
    return data


def write_text(spark: SparkSession, uri: str, text: str) -> None:
    fs, p = _path(spark, uri)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_bytes(spark: SparkSession, uri: str, parts: Iterable[bytes]) -> None:
    fs, p = _path(spark, uri)
    out = fs.create(p, True)
    for part in parts:
        out.write(bytearray(part))
    out.close()


_LEAF = 12  # bits of a line's number within a block, and of a block's within the next


def _leaves(rows: DataFrame) -> DataFrame:
    """(i, h, whole) of lines (i, h): a row for each block that lies whole in a split, and the lines of others as they are."""
    n = 1 << _LEAF

    def whole_blocks(batches):
        at, held = 0, []

        def told() -> list[tuple]:
            if len(held) == n and at % n == 0:
                return [(at // n, hashlib.sha256(b"".join(held).hex().encode()).digest(), True)]
            return [(at + k, h, False) for k, h in enumerate(held)]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            i, h, whole = zip(*rows) if rows else ((), (), ())
            return pa.record_batch([pa.array(i, pa.int64()), pa.array(h, pa.binary()), pa.array(whole, pa.bool_())], names=["i", "h", "whole"])

        for batch in batches:
            rows = []
            for line, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (line != at + len(held) or line % n == 0):
                    rows += told()
                    held = []
                if not held:
                    at = line
                held.append(h)
            yield packed(rows)
        yield packed(told())

    return rows.mapInArrow(whole_blocks, "i long, h binary, whole boolean")


def digest(spark: SparkSession, uri: str) -> str:
    """Checksum of a text file or folder of any size, made by the executors.

    A tree of SHA-256: of lines, of blocks of 4,096 lines, of 4,096 blocks, and of those
    with the length in bytes.  Lines are numbered over the whole text, so the splits by which it
    is read make no difference; compressed text is checked by what it holds.  Blocks that
    lie whole in a split are summed up where they are read, and only lines of others are sent.
    """
    rows = raw_lines(spark, uri).select((F.col("line") - 1).alias("i"), F.unhex(F.sha2("value", 256)).alias("h"))
    text = lambda h: F.lower(F.hex(h))
    summed, whole = _leaves(rows), F.col("whole")
    for _ in range(2):
        inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: text(x["h"])), "")
        lines = summed.groupBy(F.when(whole, F.col("i")).otherwise(F.shiftright("i", _LEAF)).alias("_j")).agg(F.max("whole").alias("_w"), F.max(F.when(whole, F.col("h"))).alias("_h"), inside.alias("_t"))
        summed = lines.select(F.col("_j").alias("i"), F.when(F.col("_w"), F.col("_h")).otherwise(F.unhex(F.sha2("_t", 256))).alias("h"), F.lit(False).alias("whole"))
    top = summed.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: text(x["h"])), "").alias("t")).first().t  # a row for each 16 million lines
    return "tree:" + hashlib.sha256(f"{top} {length(spark, uri)}".encode()).hexdigest()


def length(spark: SparkSession, uri: str) -> int:
    """Bytes of a file, or of a folder's files that count."""
    if is_folder(spark, uri):
        return sum(size(spark, f"{uri}/{n}") for n in text_parts(spark, uri))
    return size(spark, uri)


def held(spark: SparkSession, uri: str) -> int:
    """Bytes of all files under a path."""
    fs, p = _path(spark, uri)
    return fs.getContentSummary(p).getLength()


def is_folder(spark: SparkSession, uri: str) -> bool:
    fs, p = _path(spark, uri)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def text_parts(spark: SparkSession, uri: str) -> list[str]:
    """The files of a folder that count, by name."""
    return [n for n in list_names(spark, uri) if not n.startswith(("_", "."))]


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that spark.checkpoint.dir names.
    Only a local session may go without and gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="strandline-")
    return _OWN[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/strandline/{name}-{uuid.uuid4().hex}"


def write_lines(lines: DataFrame, uri: str, *order: str, compression: str = "none") -> str:
    """Writes the column value as text, in order over the parts of a folder."""
    rows = lines.repartitionByRange(*order).sortWithinPartitions(*order) if order else lines
    rows.select("value").write.option("compression", compression).text(uri)
    return uri


def _blocks(spark: SparkSession, uri: str, block: int = 8 << 20):
    fs, p = _path(spark, uri)
    stream, io = fs.open(p), spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    left = fs.getFileStatus(p).getLen()
    while left > 0:
        data = bytes(io.toByteArray(stream, min(block, left)))
        left -= len(data)
        yield data
    stream.close()


def is_gzip(spark: SparkSession, uri: str) -> bool:
    """By its first two bytes, whatever its name."""
    fs, p = _path(spark, uri)
    s = fs.open(p)
    head = s.read(), s.read()
    s.close()
    return head == (0x1F, 0x8B)


def lines(spark: SparkSession, uri: str) -> DataFrame:
    """(file, line, value, block), lines from 1, without the carriage return at their end; a
    folder's files follow each other by name.

    A plain file of any size is read by Hadoop's splits; a line's number is its place in its
    split plus the lines of the splits before it, of which there is one row each.  block
    names the split, for sums and states that are carried over lines.  Compressed files
    cannot be split; a gzip file of another name is unpacked by Python.
    """
    bare = F.when(F.contains("value", F.lit("\r")), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value"))
    return raw_lines(spark, uri).select(F.lit(uri).alias("file"), "line", bare.alias("value"), "block")


def raw_lines(spark: SparkSession, uri: str) -> DataFrame:
    """(line, value, block) of lines as they are."""
    if not is_folder(spark, uri) and is_gzip(spark, uri) and not uri.endswith(".gz"):

        def unpack(batches):
            for batch in batches:
                for content in batch.column(0).to_pylist():
                    rows = zlib.decompress(content, 47).decode("utf-8").split("\n")
                    yield pa.record_batch([pa.array(range(1, len(rows) + 1), pa.int64()), pa.array(rows, pa.string())], names=["line", "value"])

        rows = spark.read.format("binaryFile").load(uri).select("content").mapInArrow(unpack, "line long, value string").withColumn("block", F.lit(0).cast("long"))
    else:
        # rows of a split are neighbours in one partition, so their ids go up by one
        text = spark.read.option("lineSep", "\n").text(uri).select("value", F.col("_metadata.file_path").alias("_p"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_id"))
        rows = text.join(F.broadcast(_splits(spark, uri, text)), ["_p", "_s"]).withColumn("line", F.col("_id") + F.col("_shift"))
    return rows.select("line", "value", "block")


_SPLITS: dict[tuple, list] = {}


def _splits(spark: SparkSession, uri: str, text: DataFrame) -> DataFrame:
    """A row for each split of text as it is now: its number, and what makes its ids line numbers.  Lines are counted once, however often the text is read."""
    fs, p = _path(spark, uri)
    found = [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p)]
    how = [spark.conf.get(f"spark.sql.files.{c}", None) for c in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum", "maxPartitionNum")]
    key = (spark.sparkContext.applicationId, uri, tuple(sorted(found)), *how, spark.sparkContext.defaultParallelism)
    if key not in _SPLITS:
        by = Window.orderBy("_p", "_s")
        counted = text.groupBy("_p", "_s").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
        before = F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = counted.select("_p", "_s", (F.row_number().over(by) - 1).cast("long").alias("block"), (before + 1 - F.col("_first")).alias("_shift")).collect()
        if len(_SPLITS) >= 64:
            _SPLITS.pop(next(iter(_SPLITS)))
        _SPLITS[key] = [tuple(r) for r in rows]
    return spark.createDataFrame(_SPLITS[key], "_p string, _s long, block long, _shift long")


def first_line(spark: SparkSession, uri: str) -> str | None:
    """The first line that isn't blank; nothing is read beyond it but the rest of its split."""
    parts = [f"{uri}/{n}" for n in text_parts(spark, uri)] if is_folder(spark, uri) else [uri]
    for part in parts:
        if part == uri and is_gzip(spark, uri) and not uri.endswith(".gz"):
            found = raw_lines(spark, uri).filter(F.trim("value", F.lit(" \t\r\x0b\x0c")) != "").orderBy("line").select("value").first()
        else:  # splits of one file are read in order
            found = spark.read.option("lineSep", "\n").text(part).filter(F.trim("value", F.lit(" \t\r\x0b\x0c")) != "").first()
        if found:
            return found[0]
    return None


def carried_sum(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with the running sum of value over the lines: within a block, plus the blocks before."""
    rows = rows.withColumn("_v", value)
    sums = rows.groupBy("block").agg(F.sum("_v").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each split
    inside = F.sum("_v").over(Window.partitionBy("block").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_in", inside).join(F.broadcast(sums.select("block", before.alias("_before"))), "block").withColumn(name, F.col("_in") + F.col("_before")).drop("_v", "_in", "_before")


def carried_last(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with the last value up to their line that is not null, from their block or those before."""
    rows = rows.withColumn("_v", value)
    lasts = rows.groupBy("block").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("line"))).alias("_n"))
    before = F.last("_n", ignorenulls=True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each split
    inside = F.last("_v", ignorenulls=True).over(Window.partitionBy("block").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_in", inside).join(F.broadcast(lasts.select("block", before.alias("_before"))), "block").withColumn(name, F.coalesce("_in", "_before")).drop("_v", "_in", "_before")
