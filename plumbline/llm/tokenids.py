"""Token ids of documents in binary files, each with a minimal perfect hash index from document key to place.

File, all little-endian: magic ``PLTK``, uint32 version, uint32 bytes of an id (2 where every id fits, else 4); then the raw ids,
documents in ascending doc_id order, each with its end id; then the index, sections at places that the end of the file gives:

* levels: bits of a minimal perfect hash of the distinct keys. In level k a key's position is its hash for that level
  modulo the level's size; keys alone at their position stay there, the others go on to the next level. A key's slot is the
  number of set bits before its own in all levels; ranks hold that number for each ``RANK`` bits;
* slots: fingerprint (uint32 of another hash, so that a strange key is refused), count (documents that repeat the key) and first
  (the key's first document in the file) by slot;
* doc_id, null and start (ids before the document in this file) by document.

So a key costs a read of some bytes in each section, whatever the file's size. A file's first and last key stand in the manifest,
of which the driver keeps a row for each file, ``MOST_FILES`` at most; a key's file is found by bisection.

Spark range-partitions the documents by (doc_id, hash of the text, row), so that any repeats are cut too, and sorts within
partitions; each task streams its ids to one file, written under an attempt's name and renamed, so a task that runs again
leaves one whole file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import END_ID, TOKENIZER, shared_dir
from .tokens import encoder

HEAD = struct.Struct("<4sII")
MAGIC, VERSION = b"PLTK", 2
GAMMA = 2
RANK = 512
#: UTF-8 bytes of text for each file, of which a document counts ``ROW_BYTES`` more, and files at most: beyond both, files grow.
FILE_BYTES, ROW_BYTES, MOST_FILES = 32 << 20, 64, 1 << 16
BLOCK = 4 << 20
SLOT = np.dtype([("fingerprint", "<u4"), ("count", "<u4"), ("first", "<u8")])
SECTIONS = ("levels", "ranks", "slots", "doc_id", "null", "start")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys."""
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        for mult, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Keys are distinct uint64; null ids have a key of their own outside the int64 range's use (see :func:`as_keys`)."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        #: Set bits before each bit, over all levels before too.
        self.ranks = []
        before = 0
        for bits in levels:
            n = np.unpackbits(bits, bitorder="little")
            self.ranks.append(before + np.concatenate(([0], np.cumsum(n, dtype=np.int64))))
            before = int(self.ranks[-1][-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left, k = [], keys, 0
        while len(left):
            size = -(-max(8, GAMMA * len(left)) // 8) * 8
            at = (_mix(left, k) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            levels.append(np.packbits(bits, bitorder="little"))
            left, k = left[~alone], k + 1
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that no level has; another strange key may get any slot."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (_mix(keys[open_], k) % np.uint64(8 * len(bits))).astype(np.int64)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            out[open_[hit]] = self.ranks[k][at[hit]]
            open_ = open_[~hit]
        return out


def as_keys(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """A null id's key is a fixed odd constant; a real id that equals it would share its slot's documents, and is told apart
    by the null flags."""
    keys = ids.astype(np.int64).view(np.uint64).copy()
    keys[null] = np.uint64(0xD1B54A32D192ED03)
    return keys


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else os.path.abspath(uri))


def _write_file(batches: Iterator[pa.RecordBatch], folder: str, part: int, tokenizer: str, end_id: int) -> pa.RecordBatch | None:
    fs, root = _fs(folder)
    enc = encoder(tokenizer, end_id)
    width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    temporary, final = f"{root}/.{part}-{uuid.uuid4().hex}", f"{root}/part-{part:06d}.ids"
    ids, nulls, counts, total, held = [], [], [], 0, []
    out = None
    for batch in batches:
        if out is None:
            fs.create_dir(root, recursive=True)
            out = fs.open_output_stream(temporary)
            out.write(HEAD.pack(MAGIC, VERSION, width))
        column = batch.column("doc_id")
        nulls.append(np.asarray(column.is_null()))
        ids.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        for text in batch.column("text"):
            raw = enc.encode(text.as_py())
            n = len(raw) // 4
            counts.append(n)
            total += n
            held.append(np.frombuffer(raw, "<u4").astype(f"<u{width}").tobytes() if width == 2 else raw)
            if len(held) >= 256:
                out.write(b"".join(held))
                held.clear()
    if out is None:
        return None
    out.write(b"".join(held))
    doc_id, null = np.concatenate(ids), np.concatenate(nulls)
    start = np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))
    keys = as_keys(doc_id, null)
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (null[1:] != null[:-1]))))
    distinct = np.unique(keys[first])
    mph = PerfectHash.build(distinct)
    slots = np.zeros(len(distinct), SLOT)
    at = mph.slots(keys[first])
    slots["fingerprint"][at] = (_mix(keys[first], 99) >> np.uint64(32)).astype(np.uint32)
    slots["first"][at] = first
    slots["count"][at] = np.diff(np.concatenate((first, [len(keys)])))
    ranks = np.concatenate([np.append(r[:-1:RANK], r[-1]) for r in mph.ranks])
    place, ends = HEAD.size + total * width, []
    for section in (b"".join(x.tobytes() for x in mph.levels), ranks.astype("<i8").tobytes(), slots.tobytes(), doc_id.astype("<i8").tobytes(), null.tobytes(), start.astype("<i8").tobytes()):
        ends.append((place, len(section)))
        out.write(section)
        place += len(section)
    sizes = [8 * len(x) for x in mph.levels]
    end = struct.pack(f"<{len(sizes)}Q", *sizes) + struct.pack("<12Q", *[x for e in ends for x in e])
    out.write(end + struct.pack("<QQI", total, len(doc_id), len(sizes)))
    out.close()
    fs.move(temporary, final)
    row = {"part": part, "file": f"{folder}/part-{part:06d}.ids", "docs": len(doc_id), "ids": total, "first": None if null[0] else int(doc_id[0]), "last": None if null[-1] else int(doc_id[-1])}
    return pa.RecordBatch.from_pylist([row], schema=MANIFEST)


MANIFEST = pa.schema([("part", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


class File(NamedTuple):
    """A row of the manifest: file, documents, ids, ids in all files before, and the keys (0, 0) for null or (1, doc_id) at its ends."""

    file: str
    docs: int
    ids: int
    before: int
    first: tuple[int, int]
    last: tuple[int, int]


def _order(doc_id: int | None) -> tuple[int, int]:
    return (0, 0) if doc_id is None else (1, doc_id)


def write(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> list[File]:
    """Writes the files and returns the manifest, in doc_id order.

    Null ids come first; null texts are empty; repeated ids stand together, in several files if need be; an empty table writes no file.
    Other columns of docs are not read.
    """
    spark = docs.sparkSession
    text, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(spark.sparkContext.defaultParallelism, min(MOST_FILES, (text + ROW_BYTES * rows) // FILE_BYTES + 1))

    def task(batches):
        from pyspark import TaskContext

        made = _write_file(batches, folder, TaskContext.get().partitionId(), tokenizer, end_id)
        if made is not None:
            yield made

    made = (
        docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
        .repartitionByRange(parts, F.col("doc_id"), F.xxhash64("text"), F.col("row"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "row").select("doc_id", "text")
        .mapInArrow(task, "part long, file string, docs long, ids long, first long, last long").collect()
    )
    out, before = [], 0
    for r in sorted(made, key=lambda r: r.part):
        out.append(File(r.file, r.docs, r.ids, before, _order(r["first"]), _order(r["last"])))
        before += r.ids
    return out


class Reader:
    """Keyed access to one file. Sections are read in part for one key and whole for many."""

    def __init__(self, file: str):
        fs, path = _fs(file)
        self.file, self.source = file, fs.open_input_file(path)
        magic, version, self.width = HEAD.unpack(self.source.read_at(HEAD.size, 0))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{file} is not a token id file")
        size = self.source.size()
        self.ids, self.docs, n = struct.unpack("<QQI", self.source.read_at(20, size - 20))
        end = self.source.read_at(8 * n + 96, size - 116 - 8 * n)
        self.sizes = struct.unpack(f"<{n}Q", end[: 8 * n])
        places = struct.unpack("<12Q", end[8 * n :])
        self.places = dict(zip(SECTIONS, zip(places[::2], places[1::2])))
        self._whole: dict[str, np.ndarray] = {}

    def _part(self, section: str, at: int, n: int) -> bytes:
        return self.source.read_at(n, self.places[section][0] + at)

    def section(self, name: str) -> np.ndarray:
        if name not in self._whole:
            kind = {"levels": np.uint8, "ranks": "<i8", "slots": SLOT, "doc_id": "<i8", "null": np.bool_, "start": "<i8"}[name]
            self._whole[name] = np.frombuffer(self._part(name, 0, self.places[name][1]), kind)
        return self._whole[name]

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of that key, by a few short reads."""
        key = as_keys(np.array([doc_id or 0], np.int64), np.array([doc_id is None]))
        level, rank = 0, 0
        for k, size in enumerate(self.sizes):
            at = int(_mix(key, k)[0] % np.uint64(size))
            block = at // RANK
            bits = int.from_bytes(self._part("levels", (level + block * RANK) // 8, min(RANK, size - block * RANK) // 8), "little")
            if bits >> at % RANK & 1:
                before = struct.unpack("<q", self._part("ranks", 8 * (rank + block), 8))[0]
                slot = before + (bits & ((1 << at % RANK) - 1)).bit_count()
                found = np.frombuffer(self._part("slots", slot * SLOT.itemsize, SLOT.itemsize), SLOT)[0]
                first, count = int(found["first"]), int(found["count"])
                own, null = struct.unpack("<q", self._part("doc_id", 8 * first, 8))[0], self._part("null", first, 1) != b"\0"
                if found["fingerprint"] != _mix(key, 99)[0] >> np.uint64(32) or null != (doc_id is None) or own != (doc_id or 0):
                    return []
                start = np.frombuffer(self._part("start", 8 * first, 8 * (count + 1)), "<i8")
                return self._payloads(start)
            level, rank = level + size, rank + -(-size // RANK) + 1
        return []

    def find(self, ids: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; 0 documents for a key that the file lacks."""
        if "hash" not in self.__dict__:
            cuts = np.cumsum((0, *self.sizes)) // 8
            self.hash = PerfectHash([self.section("levels")[a:b] for a, b in zip(cuts, cuts[1:])])
        keys = as_keys(ids, null)
        slot = self.hash.slots(keys)
        found = self.section("slots")[slot]
        first = found["first"].astype(np.int64)
        ok = (slot >= 0) & (found["fingerprint"] == (_mix(keys, 99) >> np.uint64(32)).astype(np.uint32))
        ok &= (self.section("doc_id")[first] == np.where(null, 0, ids)) & (self.section("null")[first] == null)
        return np.where(ok, first, -1), np.where(ok, found["count"], 0).astype(np.int64)

    def _payloads(self, start: np.ndarray) -> list[np.ndarray]:
        at, to = int(start[0]), int(start[-1])
        block = np.frombuffer(self.source.read_at((to - at) * self.width, HEAD.size + at * self.width), f"<u{self.width}")
        return [block[a - at : b - at] for a, b in zip(start.tolist(), start[1:].tolist())]

    def payloads(self, documents: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(document, ids) of ascending documents; neighbours are read at once, about ``BLOCK`` bytes of them."""
        start, a = self.section("start"), 0
        apart = np.append(np.flatnonzero(np.diff(documents) != 1) + 1, len(documents))
        while a < len(documents):
            end = int(apart[np.searchsorted(apart, a, "right")])
            reach = int(np.searchsorted(start, start[documents[a]] + BLOCK // self.width, "right")) - 1
            b = min(end, max(a + 1, a + reach - int(documents[a])))
            yield from zip(documents[a:b].tolist(), self._payloads(start[documents[a] : documents[b - 1] + 2]))
            a = b


def fetch(keys: DataFrame, manifest: list[File], key: str = "doc_id") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as uint32): a row for each document of each of
    keys, found through its file's index. Keys that no file has give no row; repeated keys count once."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    spark = keys.sparkSession
    if not manifest:
        return spark.createDataFrame([], schema)
    firsts, lasts = [f.first for f in manifest], [f.last for f in manifest]

    def routed(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            spans = [(bisect_left(lasts, k), bisect_right(firsts, k)) for k in map(_order, ids)]
            rows = [(f, i) for i, (a, b) in zip(ids, spans) for f in range(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], names=["file", "doc_id"])

    def answered(batches):
        reader, at = None, -1
        for batch in batches:
            files, ids = batch.column("file").to_numpy(zero_copy_only=False), batch.column("doc_id")
            null = np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for f in np.unique(files).tolist():
                if f != at:
                    reader, at = Reader(manifest[f].file), f
                mine = files == f
                first, count = reader.find(ids[mine], null[mine])
                first, count = first[count > 0], count[count > 0]
                order = np.argsort(first, kind="stable")
                documents = np.repeat(first[order], count[order]) + np.concatenate([np.arange(c) for c in count[order]] or [np.zeros(0, np.int64)])
                rows = [(d, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, x in reader.payloads(documents)]
                d = np.array([r[0] for r in rows], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.section("doc_id")[d], pa.int64(), mask=np.array(reader.section("null")[d])),
                        pa.array(reader.section("start")[d] + manifest[f].before, pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    sent = keys.select(F.col(key).cast("long").alias("doc_id")).distinct().mapInArrow(routed, "file int, doc_id long")
    return sent.repartition(min(len(manifest), 4096), "file").sortWithinPartitions("file", "doc_id").mapInArrow(answered, schema)


def lookup(manifest: list[File], doc_id: int | None) -> list[np.ndarray]:
    """The ids of each document with that key, in constant time but for the bisection: one file, or the neighbours that its repeats fill."""
    k = _order(doc_id)
    a, b = bisect_left(manifest, k, key=lambda f: f.last), bisect_right(manifest, k, key=lambda f: f.first)
    return [x for f in manifest[a:b] for x in Reader(f.file).get(doc_id)]


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Writes the documents and reads every one back by its key."""
    folder = f"{shared_dir(docs.sparkSession)}/ids"
    return fetch(docs.select("doc_id"), write(docs, folder, tokenizer, end_id))
