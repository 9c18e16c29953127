"""Token ids in Arrow files of equal-length sequences, with masks.

A shard is an Arrow IPC file of record batches with two columns: ``input_ids``,
fixed-size lists of ``seq_len`` unsigned ids, and ``mask``, fixed-size lists of
booleans that are false only in the padding at the end of the shard's last
sequence.  Texts follow each other without gaps, so id number p of a shard is in
sequence p // seq_len at p % seq_len; a memory map reads any of them without a
copy.  Beside each shard lies an index file with (doc_id, start, n_tokens) of its
texts, start counted in the shard.  The manifest, a Parquet table, names the
shards that count: a task that is run again writes files of other names, and only
those of the attempt that succeeded come into the manifest.

Ids take 16 bits where the vocabulary allows, else 32.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import workspace
from strandline.llm.textkernel import span_hashes

SEQ_LEN = 2048
BATCH_SEQUENCES = 256
ENCODE_BYTES = 1 << 19

_ENCODERS: dict[str, "Encoder"] = {}

# The normaliser and splitter for which LowerCasePieces finds the pieces itself.
_LOWER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids of whole texts, from the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path = path
        self.dtype = np.dtype("<u2" if self._size() <= 1 << 16 else "<u4")

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.asarray(e.ids, self.dtype) for e in found]


class LowerCasePieces(Encoder):
    """The same ids, with the pieces of most texts found in numpy and each distinct piece
    encoded once.

    For tokenizers that lower the case and split into contractions, runs of letters,
    single digits and runs of other signs.  Texts with other characters than ASCII and
    the letters up to U+00FF, or with a special token in them, are encoded whole.
    Pieces are known by a 64-bit hash in a table of bounded size, which is emptied when
    it is full.
    """

    SLOTS = 1 << 20
    PROBES = 8
    ENCODE_RUN = 100

    def __init__(self, path: str, special: list[bytes]):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.special = special
        self.model = Tokenizer.from_file(path)  # for pieces; the tokenizer itself is loaded when a text needs it
        super().__init__(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.mark = self.model.encode(" \x02 ", add_special_tokens=False).ids
        kind = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other, 4 not handled here
        kind[0x20] = kind[0x09:0x0E] = 0
        kind[0x41:0x5B] = kind[0x61:0x7B] = kind[0x80:0xC0] = kind[0xC3] = 1
        kind[0x30:0x3A] = 2
        kind[:0x09] = kind[0x0E:0x20] = kind[0x7F] = kind[0xC0:0xC3] = kind[0xC4:] = 4
        self.kind = kind
        self._clear()

    def _size(self) -> int:
        return self.model.get_vocab_size()

    @staticmethod
    def special_tokens(path: str) -> list[bytes] | None:
        """The special tokens of a tokenizer that this class can stand for, else None."""
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        split, normal = config.get("pre_tokenizer") or {}, config.get("normalizer") or {}
        steps = split.get("pretokenizers") or [{}]
        fits = normal.get("normalizers") == _LOWER and steps[0].get("pattern") == {"Regex": _SPLIT} and len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not config.get("post_processor")
        return [t["content"].encode() for t in config["added_tokens"]] if fits else None

    def _clear(self) -> None:
        self.keys, self.values = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
        self.begin, self.size, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int32), np.zeros(0, self.dtype)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each piece, 0 if it isn't known."""
        out = np.zeros(len(h), np.int32)
        rest = np.arange(len(h))
        for p in range(self.PROBES):
            at = (h[rest] >> np.uint64(40)) + np.uint64(p) & np.uint64(self.SLOTS - 1)
            hit = self.keys[at] == h[rest]
            out[rest[hit]] = self.values[at[hit]]
            rest = rest[~hit & (self.keys[at] != 0)]
            if not len(rest):
                break
        return out

    def _learn(self, h: np.ndarray, pieces: list[bytes]) -> np.ndarray:
        """Encodes new pieces and returns their numbers; those without a slot are not kept."""
        found: list[bytes] = []
        strings = [p.decode() for p in pieces]
        for i in range(0, len(strings), self.ENCODE_RUN):
            ids = np.asarray(self.model.encode_batch_fast([" \x02 ".join(strings[i : i + self.ENCODE_RUN])], add_special_tokens=False)[0].ids, self.dtype)
            found += np.split(ids, np.flatnonzero(ids == self.mark[0]))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        sizes[np.arange(len(found)) % self.ENCODE_RUN != 0] -= 1  # the mark before it
        flat = np.concatenate(found)
        flat = flat[flat != self.mark[0]]
        number = len(self.begin) + np.arange(len(h), dtype=np.int32)
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes.astype(np.int32)])
        self.ids = np.concatenate([self.ids, flat])
        rest = np.arange(len(h))
        for p in range(self.PROBES):
            at = (h[rest] >> np.uint64(40)) + np.uint64(p) & np.uint64(self.SLOTS - 1)
            free = self.keys[at] == 0
            first = np.zeros(len(rest), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = h[rest[put]], number[rest[put]]
            rest = rest[~put]
            if not len(rest):
                break
        return number

    def _pieces(self, texts: list[bytes]):
        buf = b" ".join(texts)
        raw = np.frombuffer(buf, np.uint8)
        kind = self.kind[raw]
        before = np.concatenate([[np.uint8(0x20)], raw[:-1]])
        follows = (raw >= 0x80) & (raw < 0xC0)
        bad = (kind == 4) | follows & ((before != 0xC3) | (raw == 0x97) | (raw == 0xB7))
        bad[:-1] |= (raw[:-1] == 0xC3) & ~follows[1:]
        lower = raw.copy()
        lower[follows & (raw < 0x9F)] += 0x20
        space = kind == 0
        last = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
        new = ((kind != last) | (kind == 2)) & ~space
        if b"'" in buf:
            q = np.flatnonzero((raw == 0x27) & (last != 3))
            low = np.concatenate([raw | 0x20, np.zeros(3, np.uint8)])
            one, two = low[q + 1], low[q + 2]
            short = np.isin(one, list(b"stmd"))
            pair = (one == 0x72) & (two == 0x65) | (one == 0x76) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
            new = np.concatenate([new, [False] * 4])
            for places, n in ((q[short], 2), (q[pair & ~short], 3)):
                new[places + 1] = False
                new[places + n] |= np.concatenate([~space, [False] * 4])[places + n]
            new = new[: len(raw)]
        start = np.flatnonzero(new)
        stop = np.concatenate([new | space, [True]])[1:] & ~space
        return buf, raw, lower, bad, start, np.flatnonzero(stop) + 1

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        out: list = [None] * len(texts)
        rest = [i for i in range(len(texts)) if i not in set(whole)]
        for _ in range(2):  # again without the texts that hold other characters
            part = [texts[i] for i in rest]
            if not part:
                break
            lens = np.fromiter(map(len, part), np.int64, len(part))
            begins = np.cumsum(lens + 1) - (lens + 1)
            buf, raw, lower, bad, start, end = self._pieces(part)
            if bad.any():
                odd = set(np.unique(np.searchsorted(begins, np.flatnonzero(bad), side="right") - 1).tolist())
                whole += [rest[k] for k in odd]
                rest = [i for k, i in enumerate(rest) if k not in odd]
                continue
            h = span_hashes(lower, start, end)
            h[h == 0] = 1
            if len(self.begin) > self.SLOTS // 2:
                self._clear()
            number = self._find(h)
            new = np.flatnonzero(number == 0)
            if len(new):
                keys, first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
                at = new[first]
                low = lower.tobytes()
                number[new] = self._learn(keys, [low[a:b].lower() for a, b in zip(start[at].tolist(), end[at].tolist())])[inverse]
            size = self.size[number].astype(np.int64)
            ends = np.cumsum(size)
            index = np.repeat(self.begin[number] - (ends - size), size)
            flat = self.ids[index + np.arange(len(index))]
            cuts = np.concatenate([[0], ends])[np.searchsorted(start, begins[1:])]
            for i, ids in zip(rest, np.split(flat, cuts)):
                out[i] = ids
            break
        if whole:
            for i, ids in zip(whole, super().encode([texts[i] for i in whole])):
                out[i] = ids
        return out


def encoder(path: str, special: list[bytes] | None) -> Encoder:
    """The encoder of a worker process; special is LowerCasePieces.special_tokens(path)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path) if special is None else LowerCasePieces(path, special)
    return _ENCODERS[path]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class ShardWriter:
    """Writes a shard and its index; keeps one batch of sequences in memory."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, seq_len: int):
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        self.name, self.dtype, self.seq_len = name, dtype, seq_len
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("input_ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [fs.open_output_stream(f"{path}/{name}.arrow"), fs.open_output_stream(f"{path}/{name}.index.arrow")]
        self.file = pa.ipc.new_file(self.sinks[0], self.schema)
        self.index = pa.ipc.new_file(self.sinks[1], self.index_schema)
        self.pending, self.have, self.total, self.docs = [], 0, 0, 0

    def write(self, doc_ids: pa.Array, ids: list[np.ndarray]) -> None:
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = self.total + np.cumsum(n) - n
        self.index.write_batch(pa.record_batch([doc_ids.cast(pa.int64()), pa.array(starts), pa.array(n)], schema=self.index_schema))
        self.pending.extend(ids)
        self.have += int(n.sum())
        self.total += int(n.sum())
        self.docs += len(ids)
        if self.have >= BATCH_SEQUENCES * self.seq_len:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.pending) if self.pending else np.empty(0, self.dtype)
        per = BATCH_SEQUENCES * self.seq_len
        at = 0
        while len(flat) - at >= per or last and at < len(flat):
            part = flat[at : at + per]
            at += len(part)
            whole = -(-len(part) // self.seq_len) * self.seq_len
            ids = np.zeros(whole, self.dtype)
            ids[: len(part)] = part
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, np.arange(whole) < len(part))]
            self.file.write_batch(pa.record_batch([c.cast(f.type) for c, f in zip(columns, self.schema)], schema=self.schema))
        self.pending, self.have = [flat[at:]], len(flat) - at

    def close(self) -> None:
        self._flush(True)
        self.file.close()
        self.index.close()
        for s in self.sinks:
            s.close()


class ShardReader:
    """Zero-copy access to a shard by sequence or by range of ids."""

    def __init__(self, folder: str, name: str):
        fs, path = _open(folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        take = (lambda p: pa.memory_map(p)) if local else (lambda p: fs.open_input_file(p))
        self.handles = [take(f"{path}/{name}.arrow"), take(f"{path}/{name}.index.arrow")]
        self.file, self.index = (pa.ipc.open_file(s) for s in self.handles)
        self.seq_len = self.file.schema.field("input_ids").type.list_size

    def sequence(self, i: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of sequence i."""
        batch = self.file.get_batch(i // BATCH_SEQUENCES)
        k = i % BATCH_SEQUENCES * self.seq_len
        return batch.column(0).values.slice(k, self.seq_len), batch.column(1).values.slice(k, self.seq_len)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids of a range; a view where the range lies in one batch."""
        per, parts = BATCH_SEQUENCES * self.seq_len, []
        while n > 0:
            values = self.file.get_batch(start // per).column(0).values
            part = values.slice(start % per, min(n, per - start % per)).to_numpy(zero_copy_only=True)
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def texts(self) -> Iterator[pa.RecordBatch]:
        for i in range(self.index.num_record_batches):
            yield self.index.get_batch(i)

    def close(self) -> None:
        for s in self.handles:
            s.close()


@dataclass
class TokenFiles:
    """A finished set of shards: its folder and its manifest, ordered by shard."""

    spark: SparkSession
    folder: str
    manifest: DataFrame

    def documents(self) -> DataFrame:
        """What the files hold of each text: doc_id, start (ids of all texts before
        it), n_tokens, ids_crc32 of the ids as little-endian unsigned 32-bit integers,
        and the shard with the start in it."""
        folder = self.folder
        rows = [(r.shard, r.name, r.n_tokens) for r in self.manifest.orderBy("shard").collect()]  # a row for each file
        starts, at = [], 0
        for shard, name, n in rows:
            starts.append((shard, name, at))
            at += n
        schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, shard_start long"
        if not starts:
            return self.spark.createDataFrame([], schema)

        def read(batches):
            for batch in batches:
                for shard in batch.to_pylist():
                    reader = ShardReader(folder, shard["name"])
                    for index in reader.texts():
                        at, n = index.column(1).to_numpy(), index.column(2).to_numpy()
                        crc = [zlib.crc32(reader.ids(a, k).astype("<u4").tobytes()) for a, k in zip(at.tolist(), n.tolist())]
                        yield pa.record_batch(
                            [index.column(0), pa.array(at + shard["base"]), index.column(2), pa.array(crc, pa.int64()), pa.array([shard["name"]] * len(n)), index.column(1)],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "shard_start"],
                        )
                    reader.close()

        shards = self.spark.createDataFrame(starts, "shard long, name string, base long")
        shards = shards.repartition(len(starts), "shard") if len(starts) > 1 else shards
        return shards.mapInArrow(read, schema)


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    end_id: int = 2,
    seq_len: int = SEQ_LEN,
    folder: str | None = None,
    order_by: list[Column] | None = None,
) -> TokenFiles:
    """Encode whole texts and write them in ascending order of ``order_by`` (doc_id).

    A null text is empty and yields the end id alone; null ids come first; rows
    that repeat an id are all written, by a hash of their text among themselves, so
    that only equal rows are interchangeable;
    an empty table makes no shard.  Other columns are ignored.  Sorting is by range,
    so each task holds one batch of rows, and sequences never need the driver.
    """
    spark = docs.sparkSession
    workspace.ship(spark)
    folder = folder or workspace.new_path(spark, "tokens")
    order = [*(order_by or [F.col("doc_id")]), F.xxhash64(F.col("text").cast("string"))]
    keys = [f"_k{i}" for i in range(len(order))]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[c.alias(k) for c, k in zip(order, keys)])
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text", F.spark_partition_id().alias("_p"))

    special = LowerCasePieces.special_tokens(tokenizer_path)

    def write(batches):
        enc, writer, shard = encoder(tokenizer_path, special), None, 0
        end = np.asarray([end_id], enc.dtype)
        for batch in batches:
            if writer is None:
                shard = batch.column(2)[0].as_py()
                writer = ShardWriter(folder, f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}", enc.dtype, seq_len)
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary()).to_pylist()
            first = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= ENCODE_BYTES or i + 1 == len(texts):
                    writer.write(batch.column(0).slice(first, i + 1 - first), [np.concatenate([x, end]) for x in enc.encode(texts[first : i + 1])])
                    first, size = i + 1, 0
        if writer is not None:
            writer.close()
            yield pa.record_batch(
                [pa.array([shard], pa.int64()), pa.array([writer.name]), pa.array([writer.total], pa.int64()), pa.array([writer.docs], pa.int64())],
                names=["shard", "name", "n_tokens", "n_docs"],
            )

    manifest = rows.mapInArrow(write, "shard long, name string, n_tokens long, n_docs long")
    path = f"{folder}/_manifest"
    manifest.write.parquet(path)
    return TokenFiles(spark, folder, spark.read.schema(manifest.schema).parquet(path))
