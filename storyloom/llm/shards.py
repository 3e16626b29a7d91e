"""Token ids as binary shards with a minimal perfect hash index for constant-time access by document key.

A shard file is the raw ids, then the arrays of its index, then a JSON description of these arrays, its length and a
mark. The index holds a minimal perfect hash of the shard's keys (levels of bit arrays), and for each hash slot a
fingerprint of its key and the key's row; rows are in key order and give offsets into the ids.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.shared import id_text, shared_dir, written
from storyloom.llm.textkernel import mix, pieces
from storyloom.llm.tokens import encoder

MAGIC = b"TOKSHRD1"
#: Stands for a null key in the files, before all others.
NO_KEY = -(1 << 63)


def _level(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys ^ np.uint64((0xA0761D6478BD642F * (level + 1)) % (1 << 64)))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: in each level a key alone in its place sets a bit, the others go on."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes.astype(np.int64), words
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        sizes, bits, left = [], [], keys
        while len(left):
            if len(sizes) == 64:
                raise ValueError("the keys of a perfect hash must be distinct")
            m = max(64, -(-int(gamma * len(left)) // 64) * 64)
            place = (_level(left, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(place, minlength=m) == 1
            sizes.append(m)
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[place]]
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(bits) if bits else np.zeros(0, dtype="<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level holds it; a key that was not built in may still get a slot."""
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            place = (_level(keys[open_], level) % np.uint64(m)).astype(np.int64) + self.at[level]
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.rank[word] + below)[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_level(keys, 99) >> np.uint64(32)).astype(np.uint32)


def _index(keys: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """keys in ascending order, with repeats; a repeated key finds its first row."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    row, own = np.flatnonzero(new), keys[new].astype(np.int64).view(np.uint64)
    ph = PerfectHash.build(own)
    slot = ph.slots(own)
    rows, prints = np.zeros(len(own), dtype=np.uint32), np.zeros(len(own), dtype=np.uint32)
    rows[slot], prints[slot] = row, _fingerprint(own)
    return {"keys": keys.astype(np.int64), "ends": np.cumsum(sizes).astype(np.int64), "levels": ph.sizes, "bits": ph.words, "rows": rows, "prints": prints}


class Shard:
    """A shard file opened for keyed access: two reads of the file for the index, one for each document."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        n = int.from_bytes(tail[:8], "little")
        about = json.loads(self.file.read_at(n, size - 16 - n))
        raw = self.file.read_at(size - 16 - n - about["index_at"], about["index_at"])
        self.dtype = np.dtype(about["dtype"])
        self.arrays = {a["name"]: np.frombuffer(raw, dtype=a["dtype"], count=a["n"], offset=a["at"]) for a in about["arrays"]}
        self.hash = PerfectHash(self.arrays["levels"], self.arrays["bits"])

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where the stored fingerprint shows that the shard has no such key."""
        own = keys.astype(np.int64).view(np.uint64)
        slot = self.hash.slots(own)
        good = slot >= 0
        good[good] = self.arrays["prints"][slot[good]] == _fingerprint(own[good])
        return np.where(good, self.arrays["rows"][np.where(good, slot, 0)] if len(self.arrays["rows"]) else -1, -1).astype(np.int64)

    def read(self, row: int) -> np.ndarray:
        ends = self.arrays["ends"]
        start = int(ends[row - 1]) if row else 0
        k = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((int(ends[row]) - start) * k, start * k), dtype=self.dtype)

    def get(self, key: int) -> np.ndarray | None:
        row = int(self.rows(np.array([key], dtype=np.int64))[0])
        return None if row < 0 else self.read(row)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_bytes: int = 24_000_000, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents into shard files in ascending key order and return the manifest.

    Manifest: shard, uri, first_key, last_key, n_docs, n_ids, start (ids in the shards before). A shard holds about
    ``shard_bytes`` of text; a null or empty text is the end id alone. A null key is
    kept as NO_KEY, before all others, and comes back as null. Repeated keys are kept side by side (ordered by a hash of their text); keyed access gives the first.
    A task writes under a name of its own attempt and renames, so a repeated task leaves one whole file.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_KEY)))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    folder = folder or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def write(batches):
        encode, shard = encoder(tokenizer), TaskContext.get().partitionId()
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"{path}/shard-{shard:07d}.tok"
        keys, sizes, out = [], [], None
        for b in pieces(batches, "text"):
            if out is None:
                own = f"{name}.{uuid.uuid4().hex}"
                out = fs.open_output_stream(own)
            flat, per = encode(b.column("text"))
            ends = np.cumsum(per)
            whole = np.insert(flat, ends, np.uint16(end_id)).astype("<u2")
            out.write(whole.tobytes())
            keys.append(b.column("doc_id").to_numpy())
            sizes.append(per + 1)
        if out is None:
            return
        keys, sizes = np.concatenate(keys), np.concatenate(sizes)
        at, about = 0, []
        for k, a in _index(keys, sizes).items():
            raw = np.ascontiguousarray(a).tobytes()
            raw += b"\0" * (-len(raw) % 8)
            about.append({"name": k, "dtype": a.dtype.str, "n": len(a), "at": at})
            at += len(raw)
            out.write(raw)
        note = json.dumps({"dtype": "<u2", "index_at": int(sizes.sum()) * 2, "arrays": about}).encode()
        out.write(note + len(note).to_bytes(8, "little") + MAGIC)
        out.close()
        fs.move(own, name)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "uri": [f"{folder}/shard-{shard:07d}.tok"], "first_key": pa.array([keys[0]], pa.int64()), "last_key": pa.array([keys[-1]], pa.int64()), "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([int(sizes.sum())], pa.int64())})

    manifest = written(ordered.mapInArrow(write, "shard int, uri string, first_key long, last_key long, n_docs long, n_ids long"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the files by keyed access: doc_id, start, n_tokens, ids_crc32."""

    def read(batches):
        for b in batches:
            for uri, start in zip(b.column("uri").to_pylist(), b.column("start").to_pylist()):
                shard = Shard(uri)
                keys, ends = shard.arrays["keys"], shard.arrays["ends"]
                row = shard.rows(keys)
                repeat = np.zeros(len(keys), dtype=bool)
                repeat[1:] = keys[1:] == keys[:-1]
                if not np.array_equal(row[~repeat], np.flatnonzero(~repeat)):
                    raise ValueError(f"the index of {uri} does not give its own rows")
                row[repeat] = np.flatnonzero(repeat)  # repeated keys stand after their first row
                begin = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(shard.read(int(r)).astype("<u4").tobytes()) for r in row]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, mask=keys == NO_KEY), "start": pa.array(begin + start), "n_tokens": pa.array(ends - begin), "ids_crc32": pa.array(crc, pa.int64())})

    return manifest.repartition(F.col("shard")).select("uri", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, key: int) -> np.ndarray | None:
    """One document's ids: the manifest's key ranges give the shard, its index the place."""
    for r in manifest.where(F.lit(key).between(F.col("first_key"), F.col("last_key"))).orderBy("shard").select("uri").take(2):
        if (ids := Shard(r["uri"]).get(key)) is not None:
            return ids
    return None
