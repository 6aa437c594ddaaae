"""Token-id output: raw binary shards with a minimal perfect hash index over document keys.

Documents are range-partitioned by id and sorted, encoded, and their ids written as raw little-endian unsigned integers, one shard
file per partition. A key is (doc_id, occurrence): rows that repeat an id are numbered 0, 1, ... in file order. Keys are dealt by
hash to index buckets; each bucket is a minimal perfect hash (cascaded bit arrays with ranks, "BBHash") whose slot holds a 32-bit
fingerprint of the key, its shard, offset and length. ``IndexReader`` looks up one key by a few reads of bounded size, whatever the
corpus size; ``lookup`` joins many keys with their buckets, each bucket being read once for all of its keys.

Defined results: a null text is empty (it still gets the end id); a null id sorts first and is a key of its own; repeated ids are
kept, ordered by their text's hash; an empty table gives an index without buckets. All files go to the shared folder through
pyarrow filesystems under names unique to the task attempt; only names returned by committed tasks are ever read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.common import encoder_of, materialize, narrow, open_store, shared_folder, text_or_empty, with_end

KEYS_PER_BUCKET = 1 << 16
RECORD = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n_tokens", "<u8")])
NULL_ID = -(1 << 63)  # stands for a null id inside files, beside a flag in the occurrence's sign
GAMMA, LEVELS = 2.0, 24
BLOCK = 512  # bits between stored ranks
_U = np.uint64


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer (xor-shift, multiply) of keys and a salt."""
    with np.errstate(over="ignore"):
        z = keys.astype(_U) + _U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


class MinimalPerfectHash:
    """Maps n distinct 64-bit keys one to one to 0..n-1; other keys map anywhere or to -1."""

    def __init__(self, levels: list[np.ndarray], left: np.ndarray) -> None:
        self.levels, self.left = levels, left  # per level a packed bit array; keys that no level settled, sorted
        self.bits = [np.unpackbits(b, bitorder="little") for b in levels]
        self.ranks = [np.concatenate([[0], np.cumsum(b, dtype=np.int64)]) for b in self.bits]
        self.base = np.concatenate([[0], np.cumsum([r[-1] for r in self.ranks], dtype=np.int64)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        levels, rest = [], np.asarray(keys, dtype=_U)
        while len(rest) and len(levels) < LEVELS:
            m = max(64, -(-int(len(rest) * GAMMA) // 64) * 64)
            at = (mixed(rest, len(levels)) % _U(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            rest = rest[~alone[at]]
        return cls(levels, np.sort(rest))

    def __len__(self) -> int:
        return int(self.base[-1]) + len(self.left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, dtype=_U)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (bits, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            at = (mixed(keys[open_], k) % _U(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[open_[hit]] = self.base[k] + ranks[at[hit]]
            open_ = open_[~hit]
        if len(self.left) and len(open_):
            at = np.minimum(np.searchsorted(self.left, keys[open_]), len(self.left) - 1)
            hit = self.left[at] == keys[open_]
            out[open_[hit]] = self.base[-1] + at[hit]
        return out

    def to_bytes(self) -> bytes:
        """Sizes, the levels' bits, keys left over, and for every level the ranks at each BLOCK bits, so that one key can be looked up
        by a few small reads."""
        head = struct.pack("<II", len(self.levels), len(self.left)) + b"".join(struct.pack("<I", len(b)) for b in self.levels)
        ranks = b"".join((base + r[:-1:BLOCK]).astype("<u4").tobytes() for base, r in zip(self.base, self.ranks, strict=False))
        return head + b"".join(b.tobytes() for b in self.levels) + self.left.astype("<u8").tobytes() + ranks

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalPerfectHash:
        n, left = struct.unpack_from("<II", data)
        sizes, at, levels = struct.unpack_from(f"<{n}I", data, 8), 8 + 4 * n, []
        for s in sizes:
            levels.append(np.frombuffer(data, np.uint8, s, at))
            at += s
        return cls(levels, np.frombuffer(data, "<u8", left, at).astype(_U))


def key_hash(ids: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return mixed(mixed(np.asarray(ids, np.int64).view(_U), 101) ^ np.asarray(occurrence, np.int64).view(_U), 102)


def fingerprints(ids: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return (mixed(mixed(np.asarray(ids, np.int64).view(_U), 201) ^ np.asarray(occurrence, np.int64).view(_U), 202) >> _U(32)).astype(np.uint32)


@dataclass
class TokenStore:
    """A written corpus: ``catalog`` (a row per document), ``shards`` (a row per shard file), ``buckets`` (a row per index file)."""

    spark: SparkSession
    folder: str
    catalog: DataFrame
    shards: DataFrame
    buckets: DataFrame
    n_buckets: int
    width: int


def _write_shards(folder: str, tokenizer: str, width: int, end_id: int):
    schema = pa.schema([("key_id", pa.int64()), ("occurrence", pa.int64()), ("shard", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder, out, offset, last, seen = TaskContext.get().partitionId(), None, None, 0, None, 0
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.bin"
        try:
            for batch in narrow(batches):
                if out is None:
                    store, path = open_store(folder)
                    store.create_dir(path, recursive=True)
                    encoder, out = encoder_of(tokenizer), store.open_output_stream(f"{path}/{name}")
                ids = batch.column(0).to_pylist()
                flat, counts = with_end(*encoder.encode(batch.column(1).to_pylist()), end_id)
                out.write(flat.astype(f"<u{width}").tobytes())
                occurrence = []
                for i in ids:
                    seen = seen + 1 if (i, True) == last else 0
                    last = (i, True)
                    occurrence.append(seen if i is not None else -1 - seen)
                offsets = offset + np.concatenate([[0], np.cumsum(counts)])
                offset = int(offsets[-1])
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([NULL_ID if i is None else i for i in ids], pa.int64()), pa.array(occurrence, pa.int64()), pa.array([shard] * n, pa.int32()), pa.array([name] * n), pa.array(offsets[:-1]), pa.array(counts.astype(np.int64))], schema=schema)
        finally:
            if out is not None:
                out.close()

    return write


def _build_bucket(folder: str):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = key_hash(pdf["key_id"].to_numpy(), pdf["occurrence"].to_numpy())
        index = MinimalPerfectHash.build(keys)
        records = np.zeros(len(index), RECORD)
        # two keys of one 64-bit hash share no slot: the second is kept beside, by its whole key
        order = np.argsort(keys, kind="stable")
        again = np.zeros(len(keys), bool)
        again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
        at = index.slots(keys)
        records["fingerprint"][at] = fingerprints(pdf["key_id"].to_numpy(), pdf["occurrence"].to_numpy())
        for c in ("shard", "offset", "n_tokens"):
            records[c][at] = pdf[c].to_numpy()
        side = pdf.loc[again, ["key_id", "occurrence", "shard", "offset", "n_tokens"]].to_numpy(np.int64)
        name = f"bucket-{int(pdf['bucket'].iloc[0]):06d}-{uuid.uuid4().hex}.mph"
        body = index.to_bytes()
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(struct.pack("<QQQ", len(body), len(records), len(side)) + body + records.tobytes() + side.astype("<i8").tobytes())
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "index_file": [name], "n_keys": [len(pdf)]})

    return build


def read_bucket(folder: str, name: str) -> tuple[MinimalPerfectHash, np.ndarray, dict[tuple[int, int], tuple[int, int, int]]]:
    store, path = open_store(folder)
    with store.open_input_stream(f"{path}/{name}") as f:
        data = f.read()
    body, n, side = struct.unpack_from("<QQQ", data)
    records = np.frombuffer(data, RECORD, n, 24 + body)
    rest = np.frombuffer(data, "<i8", 5 * side, 24 + body + records.nbytes).reshape(-1, 5)
    return MinimalPerfectHash.from_bytes(data[24 : 24 + body]), records, {(int(r[0]), int(r[1])): (int(r[2]), int(r[3]), int(r[4])) for r in rest}


def _bucket_of(n_buckets: int):
    return F.pmod(F.xxhash64("key_id", "occurrence"), F.lit(n_buckets)).cast("int")


def write_token_store(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, folder: str | None = None, keys_per_bucket: int = KEYS_PER_BUCKET) -> TokenStore:
    """Encode whole texts, write shards in ascending id order, and index them by key."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    slim = docs.select(F.col(id_col).cast("long").alias("__id"), text_or_empty(text_col).alias("__text"))
    # ranges take the text's hash in as well: rows of one id, or without an id, may fill several shards
    ordered = slim.repartitionByRange(F.col("__id"), F.xxhash64("__text")).sortWithinPartitions("__id", F.xxhash64("__text"), "__text")
    rows = ordered.mapInArrow(_write_shards(f"{folder}/ids", tokenizer, width, end_id), "key_id long, occurrence long, shard int, file string, offset long, n_tokens long")
    rows.write.parquet(f"{folder}/catalog")
    catalog = _numbered_through(spark.read.schema(rows.schema).parquet(f"{folder}/catalog"))
    # one row per shard file: its total, and the ids in all files before it
    shards = catalog.groupBy("shard", "file").agg(F.sum("n_tokens").alias("shard_tokens"), F.count(F.lit(1)).alias("shard_docs"))
    shards = shards.withColumn("base", F.sum("shard_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("shard_tokens"))
    shards = materialize(shards, "shards")
    n_docs = shards.agg(F.coalesce(F.sum("shard_docs"), F.lit(0))).first()[0]
    n_buckets = max(16, -(-n_docs // keys_per_bucket))
    keyed = catalog.select("key_id", "occurrence", "shard", "offset", "n_tokens").withColumn("bucket", _bucket_of(n_buckets))
    buckets = keyed.groupBy("bucket").applyInPandas(_build_bucket(f"{folder}/index"), "bucket int, index_file string, n_keys long")
    return TokenStore(spark, folder, catalog, shards, materialize(buckets, "buckets"), n_buckets, width)


def _numbered_through(catalog: DataFrame) -> DataFrame:
    """Occurrences counted on from shard to shard where an id goes over an edge: it is the first one of the later shard then."""
    key = [F.col("key_id"), (F.col("occurrence") < 0).alias("no_id")]
    first = catalog.where(F.col("offset") == 0).select(*key).distinct()  # at most a row per shard
    parts = catalog.select("shard", *key).join(F.broadcast(first), ["key_id", "no_id"]).groupBy("shard", "key_id", "no_id").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("key_id", "no_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    carried = materialize(parts.withColumn("before", before).where(F.col("before").isNotNull()).select("shard", "key_id", "no_id", "before"), "carried")
    if carried.limit(1).count() == 0:
        return catalog
    whole = catalog.withColumn("no_id", F.col("occurrence") < 0).join(F.broadcast(carried), ["shard", "key_id", "no_id"], "left")
    step = F.coalesce("before", F.lit(0))
    return whole.withColumn("occurrence", F.when(F.col("no_id"), F.col("occurrence") - step).otherwise(F.col("occurrence") + step)).select(*catalog.columns)


class IndexReader:
    """Keyed access from one process, without Spark jobs: it knows the names of the index and shard files (a row each), and a lookup
    makes a few reads of bounded size whatever the corpus: sizes, a block of bits and its rank for each level tried, a slot, the ids."""

    def __init__(self, store: TokenStore) -> None:
        self.folder, self.width, self.n_buckets = store.folder, store.width, store.n_buckets
        self.index = {r["bucket"]: r["index_file"] for r in store.buckets.collect()}
        self.shard = {r["shard"]: r["file"] for r in store.shards.select("shard", "file").collect()}

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of a document (of several rows with its id the ``occurrence``-th), or None."""
        key, times = (NULL_ID, -1 - occurrence) if doc_id is None else (doc_id, occurrence)
        digest = xxhash.xxh64_intdigest(struct.pack("<q", times), xxhash.xxh64_intdigest(struct.pack("<q", key), 42))
        name = self.index.get((digest - (digest >> 63 << 64)) % self.n_buckets)
        if name is None:
            return None
        store, path = open_store(f"{self.folder}/index")
        with store.open_input_file(f"{path}/{name}") as f:
            found = self._record(f, key, times)
        if found is None:
            return None
        shard, offset, n = found
        store, path = open_store(f"{self.folder}/ids")
        with store.open_input_file(f"{path}/{self.shard[shard]}") as f:
            return np.frombuffer(f.read_at(n * self.width, offset * self.width), f"<u{self.width}").astype("<u4")

    def _record(self, f, key: int, times: int) -> tuple[int, int, int] | None:
        head = f.read_at(32 + 4 * LEVELS, 0)
        body, n_records, side, levels, left = struct.unpack_from("<QQQII", head)
        sizes = struct.unpack_from(f"<{levels}I", head, 32)
        if side:  # keys that share their whole 64-bit hash with another: hardly ever any
            rest = np.frombuffer(f.read_at(40 * side, 24 + body + RECORD.itemsize * n_records), "<i8").reshape(-1, 5)
            for r in rest:
                if (r[0], r[1]) == (key, times):
                    return int(r[2]), int(r[3]), int(r[4])
        h = key_hash(np.array([key]), np.array([times]))
        bits = 32 + 4 * levels
        ranks = bits + sum(sizes) + 8 * left
        for k, size in enumerate(sizes):
            at = int(mixed(h, k)[0] % _U(8 * size))
            block = np.unpackbits(np.frombuffer(f.read_at(min(BLOCK // 8, size - at // BLOCK * BLOCK // 8), bits + at // BLOCK * BLOCK // 8), np.uint8), bitorder="little")
            if block[at % BLOCK]:
                rank = struct.unpack("<I", f.read_at(4, ranks + 4 * (at // BLOCK)))[0] + int(block[: at % BLOCK].sum())
                record = np.frombuffer(f.read_at(RECORD.itemsize, 24 + body + RECORD.itemsize * rank), RECORD)[0]
                mark = fingerprints(np.array([key]), np.array([times]))[0]
                return (int(record["shard"]), int(record["offset"]), int(record["n_tokens"])) if record["fingerprint"] == mark else None
            bits += size
            ranks += 4 * -(-8 * size // BLOCK)
        return self._left_over(f, h, body, left, sizes, key, times) if left else None

    @staticmethod
    def _left_over(f, h: np.ndarray, body: int, left: int, sizes: tuple[int, ...], key: int, times: int) -> tuple[int, int, int] | None:
        """Keys that no level settled (about one in ten million) stand sorted after the bits; their slots are the last ones."""
        keys = np.frombuffer(f.read_at(8 * left, 32 + 4 * len(sizes) + sum(sizes)), "<u8")
        at = int(np.searchsorted(keys, h[0]))
        if at == left or keys[at] != h[0]:
            return None
        n_records = struct.unpack("<Q", f.read_at(8, 8))[0]
        record = np.frombuffer(f.read_at(RECORD.itemsize, 24 + body + RECORD.itemsize * (n_records - left + at)), RECORD)[0]
        return (int(record["shard"]), int(record["offset"]), int(record["n_tokens"])) if record["fingerprint"] == fingerprints(np.array([key]), np.array([times]))[0] else None


def lookup(store: TokenStore, keys: DataFrame) -> DataFrame:
    """(key_id, occurrence) rows → those the index holds, with slot, fingerprint, shard, offset and n_tokens. Keys that are not in
    the store are left out (a foreign key passes its slot's fingerprint once in 2^32)."""
    folder = f"{store.folder}/index"

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        index, records, side = read_bucket(folder, pdf["index_file"].iloc[0])
        ids, occurrence = pdf["key_id"].to_numpy(), pdf["occurrence"].to_numpy()
        slots, marks = index.slots(key_hash(ids, occurrence)), fingerprints(ids, occurrence)
        found = (slots >= 0) & (records["fingerprint"][slots] == marks) if len(records) else np.zeros(len(ids), bool)
        got = records[np.where(found, slots, 0)] if len(records) else np.zeros(len(ids), RECORD)
        out = pd.DataFrame({"key_id": ids, "occurrence": occurrence, "bucket": pdf["bucket"], "slot": slots, "fingerprint": marks.astype(np.int64), "shard": got["shard"].astype(np.int64), "offset": got["offset"].astype(np.int64), "n_tokens": got["n_tokens"].astype(np.int64)})
        for k, key in enumerate(zip(ids, occurrence, strict=True)) if side else ():
            if key in side:
                out.loc[k, ["slot", "shard", "offset", "n_tokens"]] = (-1, *side[key])
                found[k] = True
        return out[found]

    asked = keys.withColumn("bucket", _bucket_of(store.n_buckets)).join(store.buckets.select("bucket", "index_file"), "bucket")
    return asked.groupBy("bucket").applyInPandas(find, "key_id long, occurrence long, bucket int, slot long, fingerprint long, shard long, offset long, n_tokens long")


def read_payloads(store: TokenStore, found: DataFrame) -> DataFrame:
    """The raw ids of looked-up keys, as little-endian 32-bit ``payload`` with ``start`` (ids in all documents before)."""
    folder, width = f"{store.folder}/ids", store.width
    names = found.schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, object] = {}
        store_, path = open_store(folder)
        try:
            for batch in batches:
                name, offset, n = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "offset", "n_tokens"))
                for a in range(0, len(name), 512):
                    payloads = []
                    for f, o, k in zip(name[a : a + 512], offset[a : a + 512], n[a : a + 512], strict=True):
                        if f not in files:
                            for old in files.values():
                                old.close()
                            files = {f: store_.open_input_file(f"{path}/{f}")}
                        payloads.append(np.frombuffer(files[f].read_at(k * width, o * width), f"<u{width}").astype("<u4").tobytes())
                    part = batch.slice(a, len(payloads))
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in (*names, "start")), pa.array(payloads, pa.binary())], names=[*names, "start", "payload"])
        finally:
            for f in files.values():
                f.close()

    placed = found.join(store.shards.select(F.col("shard").cast("long").alias("shard"), "file", "base"), "shard").withColumn("start", F.col("base") + F.col("offset"))
    placed = placed.select(*names, "file", "start").repartitionByRange("start").sortWithinPartitions("start")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return placed.mapInArrow(read, f"{kinds}, start long, payload binary")


def documents_of(store: TokenStore) -> DataFrame:
    """Every stored document, fetched through the index: its key, place and crc32 of its ids."""

    found = lookup(store, store.catalog.select("key_id", "occurrence"))
    read = read_payloads(store, found)
    doc_id = F.when(F.col("occurrence") >= 0, F.col("key_id"))
    return read.select(doc_id.alias("doc_id"), "start", "n_tokens", F.crc32("payload").alias("ids_crc32"), "shard", "slot", "fingerprint")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
