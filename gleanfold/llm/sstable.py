"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending key order:

    block*      zstd-compressed entries, about ``block_bytes`` of ids each
    index       JSON: one [last key (hex), offset, stored length, raw length] per block
    bloom       bit array over the keys
    footer      JSON (place of index and bloom, id width, counts), its length as 4 bytes, MAGIC

An entry is: shared-prefix length with the previous key (1 byte), length of the rest (1), number
of ids (4), the rest of the key, the ids. The first entry of a block shares nothing, so a block
can be read alone: a lookup reads the footer, asks the Bloom filter, finds the block by binary
search in the index, and scans that block.

Keys are order-preserving 9-byte encodings of a nullable long (nulls first).
"""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, new_path
from .tokens import default_tokenizer, encoder

MAGIC = b"GLFSST01"
_ENTRY = struct.Struct("<BBI")


def encode_key(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + 2**63)


def decode_key(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - 2**63


def _bloom_bits(key: bytes, n_bits: int, k: int) -> list[int]:
    d = hashlib.blake2b(key, digest_size=16).digest()
    a, b = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 1
    return [(a + i * b) % n_bits for i in range(k)]


def write_table(out, entries: Iterable[tuple[bytes, bytes]], width: int, block_bytes: int = 1 << 18, bits_per_key: int = 10, n_hashes: int = 7) -> dict:
    """Write sorted (key, ids) entries to a binary stream; memory is one block and the keys' Bloom hashes."""
    import pyarrow as pa

    codec = pa.Codec("zstd")
    index, keys, block, first, last, place = [], [], bytearray(), None, b"", 0
    n_tokens = 0

    def flush() -> None:
        nonlocal block, place
        if block:
            data = codec.compress(bytes(block), asbytes=True)
            out.write(data)
            index.append([last.hex(), place, len(data), len(block)])
            place += len(data)
            block = bytearray()

    for key, ids in entries:
        if len(block) >= block_bytes:
            flush()
        shared = 0
        if block:
            while shared < len(key) and key[shared] == last[shared]:
                shared += 1
        block += _ENTRY.pack(shared, len(key) - shared, len(ids) // width) + key[shared:] + ids
        first = key if first is None else first
        if key != last or not keys:
            keys.append(key)
        last = key
        n_tokens += len(ids) // width
    flush()
    n_bits = max(64, bits_per_key * len(keys)) + 7 & ~7
    bloom = bytearray(n_bits // 8)
    for key in keys:
        for b in _bloom_bits(key, n_bits, n_hashes):
            bloom[b >> 3] |= 1 << (b & 7)
    idx = json.dumps(index).encode()
    out.write(idx)
    out.write(bytes(bloom))
    footer = json.dumps({"index": [place, len(idx)], "bloom": [place + len(idx), len(bloom), n_hashes], "width": width, "tokens": n_tokens}).encode()
    out.write(footer + struct.pack("<I", len(footer)) + MAGIC)
    return {"first_key": first, "last_key": last if first is not None else None, "n_tokens": n_tokens}


class TableReader:
    """Reads a shard from a seekable binary file."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        tail = self._at(end - 12, 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a token table")
        n = struct.unpack("<I", tail[:4])[0]
        self.footer = json.loads(self._at(end - 12 - n, n))
        self.index = json.loads(self._at(*self.footer["index"]))
        self.last_keys = [bytes.fromhex(x[0]) for x in self.index]
        self.bloom = self._at(*self.footer["bloom"][:2])
        self.width = self.footer["width"]

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        import pyarrow as pa

        _, offset, stored, raw = self.index[i]
        data = pa.Codec("zstd").decompress(self._at(offset, stored), raw, asbytes=True)
        at, key = 0, b""
        while at < len(data):
            shared, rest, n = _ENTRY.unpack_from(data, at)
            at += _ENTRY.size
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n * self.width]
            at += n * self.width

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def may_contain(self, key: bytes) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_bits(key, 8 * len(self.bloom), self.footer["bloom"][2]))

    def get(self, key: bytes) -> list[bytes]:
        """The ids of every document with this key, in file order."""
        if not self.may_contain(key):
            return []
        found, i = [], bisect.bisect_left(self.last_keys, key)
        while i < len(self.index):
            hits = [ids for k, ids in self._block(i) if k == key]
            found += hits
            if self.last_keys[i] > key:
                break
            i += 1
        return found


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, n_shards: int | None = None) -> list[dict]:
    """Encode every whole text and write one shard file per range of identifiers under path.

    Returns the manifest, one entry per non-empty shard in key order, with ``start``, the number of
    ids in all shards before it, and its first and last key. Null texts count as empty; every document ends with the end id.
    Null identifiers come first; rows with the same identifier are all kept, in order of their texts' hash. An identifier with
    very many rows is spread over several shards, also if the rows are equal. Very long texts are encoded whole; other columns
    are ignored, whatever their names; an empty table gives no shard. A task that is run
    again writes the same bytes to a name of its own and renames it, so readers see whole files only.
    """
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    n = n_shards or n_partitions(spark)

    def write(batches):
        import uuid

        import numpy as np
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        width = 2 if encode.vocab_size <= 1 << 16 else 4
        n_docs, first, last = 0, b"", b""

        def entries():
            nonlocal n_docs, first, last
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(text.as_py())
                    n_docs, last = n_docs + 1, encode_key(doc_id)
                    first = first or last
                    yield last, ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()

        part = TaskContext.get().partitionId()
        name = f"{path}/shard-{part:06d}.sst"
        fs, where = _filesystem(name)
        fs.create_dir(where.rpartition("/")[0], recursive=True)
        part_file = f"{where}.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(part_file) as out:
            made = write_table(out, entries(), width)
        try:
            if n_docs:
                fs.move(part_file, where)
            else:
                fs.delete_file(part_file)
        except OSError:  # some stores don't rename onto a file: another run of this task has left the same one
            if not fs.get_file_info(where).is_file:
                raise
            fs.delete_file(part_file)
        import pyarrow as pa

        row = {"shard": part, "path": name, "n_docs": n_docs, "n_tokens": made["n_tokens"], "first": first.hex(), "last": last.hex()}
        yield pa.RecordBatch.from_pylist([row] if n_docs else [], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first", pa.string()), ("last", pa.string())]))

    # the text's hash and the partition split the rows of one identifier; both are the same if a task runs again
    order = [F.col("k").asc_nulls_first(), "h", "part"]
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).withColumns({"h": F.xxhash64("t"), "part": F.spark_partition_id()})
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    manifest = sorted((r.asDict() for r in dealt.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long, first string, last string").collect()), key=lambda r: r["shard"])  # a row per file
    at = 0
    for r in manifest:
        r["start"], at = at, at + r["n_tokens"]
    return manifest


def lookup(manifest: list[dict], doc_id: int | None) -> list[list[int]]:
    """The ids of every document with this identifier: binary search among the shards, then in each that may hold it."""
    import numpy as np

    key, found = encode_key(doc_id), []
    i = bisect.bisect_left(manifest, key.hex(), key=lambda r: r["last"])
    while i < len(manifest) and manifest[i]["first"] <= key.hex():
        fs, where = _filesystem(manifest[i]["path"])
        with fs.open_input_file(where) as f:
            table = TableReader(f)
            found += [np.frombuffer(ids, f"<u{table.width}").tolist() for ids in table.get(key)]
        i += 1
    return found


def read_token_tables(spark, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, and ids on demand."""
    import pyarrow as pa

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
    schema = pa.schema(fields)

    def read(batches):
        import zlib

        import numpy as np

        for batch in batches:
            for r in batch.to_pylist():
                fs, where = _filesystem(r["path"])
                rows, at = [], r["start"]
                with fs.open_input_file(where) as f:
                    table = TableReader(f)
                    for key, ids in table:
                        ids = np.frombuffer(ids, f"<u{table.width}").astype("<u4")
                        rows.append({"doc_id": decode_key(key), "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())} | ({"ids": ids.tolist()} if with_ids else {}))
                        at += len(ids)
                        if len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    files = spark.createDataFrame([(r["path"], r["start"]) for r in manifest], "path string, start long")
    return files.repartition(max(1, len(manifest))).mapInArrow(read, kinds)


def token_tables(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the tables (by default into the shared folder) and return what is read back from them."""
    path = path or new_path(docs.sparkSession, "sst")
    return read_token_tables(docs.sparkSession, write_token_tables(docs, path, **options))
