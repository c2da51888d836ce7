"""Token ids in training order, in shards of fixed-stride records.

A document becomes the ids of its text and an end token, cut into sequences of
``LENGTH`` ids. Sequences are numbered 0 to N - 1 in the order of the stored rows, a
keyed Feistel permutation of that range gives each its slot, and slot s is record
s mod ``RECORDS`` of shard s // ``RECORDS``. A record has ``STRIDE`` bytes:

    doc_id (8), number of the sequence in its document (4), whether there is an id (2),
    ids used (2), then LENGTH ids of two bytes, unused ones 0; all little-endian

so a reader that stopped at slot s goes on at byte (s mod RECORDS) * STRIDE.

Two passes read the rows. The first counts sequences; what it returns is one entry for
each run of rows that a task reads from a file, 24 bytes per 128 MB of input as
Spark splits it, at most ``RUNS`` of them. The second encodes, finds each sequence's slot and
packs records by shard; range partitions by shard then fill one shard at a
time, so memory is that of one shard, and shards are moved into place when
whole. The order follows the stored rows: the same files give the same slots.

Defined cases: a null or empty text is the end token alone; null ids and repeated rows
are kept, each row for itself; an empty table has no shard. Tables that aren't
read from files are stored first, so that both passes see the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readalike.llm import text_arrays as ta
from readalike.llm import token_counts as tc
from readalike.llm.files import open_ranges, write_whole
from readalike.llm.shipping import with_package
from readalike.sources.store import Store

LENGTH = 256
RECORDS = 1 << 16
HEAD = np.dtype([("doc_id", "<i8"), ("seq", "<i4"), ("has_id", "<i2"), ("n_tokens", "<i2"), ("ids", "<u2", (LENGTH,))])
STRIDE = HEAD.itemsize
KEY = 20240229
ROUNDS = 6
RUNS = 4_000_000
KEPT = 1_000_000   # chunks whose ids a worker remembers (40 bytes each), then starts anew
FRESH = 1 << 17    # of these, chunks that wait to be sorted in among the others
PIECE = 1024       # rows of a batch whose texts are copied at once

_RUN = "file long, row long, n long"
_PACKED = "shard long, records binary"
MANIFEST = "shard long, path string, first_slot long, n_records long, crc long"
SEQUENCES = "slot long, shard long, doc_id long, seq int, n_tokens int, crc long"


class Encoder:
    """Ids of whole texts, found once per distinct chunk (see ``token_counts``).

    What a worker remembers are flat arrays: sorted hashes of chunks, and where their ids lie; those of
    the last slices apart, as the arrays are copied when something is sorted in.
    """

    def __init__(self, model_file: str):
        self.machine = tc.transducer(model_file)
        self.library = self.machine.library
        self.end = self.library.eos_id()
        if self.library.get_piece_size() > 1 << 16 or not self.machine.breaks[10]:
            raise ValueError("ids don't fit two bytes, or pieces continue across line ends")
        self.mark = self.library.piece_to_id(tc.MARK)
        self.reset()

    def reset(self) -> None:
        nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known, self.fresh = nothing, nothing
        self.pool = np.zeros(1 << 16, np.uint16)
        self.used = 0

    def learn(self, texts: list[str], opens: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes chunks into the pool. The library puts a mark before what it is given, so a
        chunk's own first space is left out, and a line end and its mark are cut off again."""
        kinds = [0 if o or t == " " else 1 if t[0] == " " else 2 for t, o in zip(texts, opens, strict=True)]
        given = [t if k == 0 else t[1:] if k == 1 else "\n" + t for t, k in zip(texts, kinds, strict=True)]
        found = [[self.mark] if t == " " and not o else ids[2:] if k == 2 else ids for t, o, k, ids in
                 zip(texts, opens, kinds, self.library.encode(given, num_threads=1), strict=True)]
        size = np.array([len(ids) for ids in found], np.int64)
        total = int(size.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        begin = self.used + np.cumsum(size) - size
        self.pool[self.used:self.used + total] = np.fromiter(chain.from_iterable(found), np.uint16, total)
        self.used += total
        return begin, size

    def remembered(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of chunks lie and how many they are; -1 for unknown chunks."""
        begin, size = np.full(len(distinct), -1), np.zeros(len(distinct), np.int64)
        for key, begins, sizes in (self.known, self.fresh):
            if len(key):
                at = np.minimum(np.searchsorted(key, distinct), len(key) - 1)
                mine = np.flatnonzero(key[at] == distinct)
                begin[mine], size[mine] = begins[at[mine]], sizes[at[mine]]
        return begin, size

    def remember(self, *more: np.ndarray) -> None:
        def merged(have: tuple[np.ndarray, ...], more: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
            at = np.searchsorted(have[0], more[0])
            return tuple(np.insert(x, at, y) for x, y in zip(have, more, strict=True))

        self.fresh = merged(self.fresh, more)
        if len(self.fresh[0]) > FRESH:
            self.known, self.fresh = merged(self.known, self.fresh), tuple(x[:0].copy() for x in self.fresh)

    def slice(self, part: ta.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice with their end tokens, and how many each text has."""
        chunks = tc.chunks_of(part, self.machine.breaks)
        distinct, example, which = ta.distinct(chunks.key)
        if len(self.known[0]) + len(self.fresh[0]) > KEPT:
            self.reset()
        begins, sizes = self.remembered(distinct)
        new = np.flatnonzero(begins < 0)
        if len(new):
            begins[new], sizes[new] = self.learn(chunks.raws(example[new]), chunks.opens[example[new]].tolist())
            self.remember(distinct[new], begins[new], sizes[new])
        # The end token is one more chunk after the last of each text; it lies at the pool's end.
        if self.used == len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used] = self.end
        ends = np.cumsum(chunks.per_text)
        begin = np.insert(begins[which], ends, self.used)
        times = np.insert(sizes[which], ends, 1)
        place = np.repeat(begin - (np.cumsum(times) - times), times)
        place += np.arange(len(place))
        last = np.cumsum(chunks.per_text + 1)
        upto = np.concatenate(([0], np.cumsum(times)))
        return self.pool[place], upto[last] - upto[last - chunks.per_text - 1]


@lru_cache(maxsize=2)
def encoder(model_file: str) -> Encoder:
    return Encoder(model_file)


def encoded(texts: pa.Array, code: Encoder) -> Iterator[tuple[int, ta.Slice, np.ndarray, np.ndarray]]:
    """Slice by slice the row of its first text, the slice, the ids of its texts and how many each text has. Texts are
    copied ``PIECE`` rows at a time."""
    for k in range(0, len(texts), PIECE):
        for part in ta.slices(tc.plain(texts.slice(k, PIECE))):
            yield k + part.first, part, *code.slice(part)
    pa.default_memory_pool().release_unused()


def permuted(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Keyed permutation of 0 .. n - 1: a balanced Feistel network on the smallest even
    number of bits, applied again where the outcome isn't below n."""
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    low = np.uint64((1 << int(half)) - 1)
    keys = ta.mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key % (1 << 63)))
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for k in keys:
            left, right = right, left ^ (ta.mixed(right + k) & low)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def located_rows(docs: DataFrame, store: Store) -> DataFrame:
    """(doc_id, text, file, row): file and row say where the row is stored."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
               F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return with_package(docs).select(*columns)
    except AnalysisException:
        return with_package(store.write(docs.select("doc_id", "text"))).select(*columns)


def runs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    file, row = batch.column("file").to_numpy(), batch.column("row").to_numpy()
    new = np.append(True, (file[1:] != file[:-1]) | (row[1:] < row[:-1]))
    return file, row, np.flatnonzero(new)


def sequence_numbers(rows: DataFrame, model_file: str) -> dict[tuple[int, int], int]:
    """Number of the first sequence of each run of rows that a task reads."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(model_file)
        found: list[list[int]] = []
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            n = np.concatenate([-(-size // LENGTH) for _, _, _, size in encoded(batch.column("text"), code)])
            file, row, begin = runs_of(batch)
            total = np.add.reduceat(n, begin)
            for k, b in enumerate(begin):
                if k == 0 and before is not None and before[0] == file[0] and before[1] < row[0]:
                    found[-1][2] += int(total[0])
                else:
                    found.append([int(file[b]), int(row[b]), int(total[k])])
            before = file[-1], row[-1]
        columns = zip(*found, strict=True) if found else ([], [], [])
        yield pa.RecordBatch.from_pydict({
            name: pa.array(list(values), pa.int64()) for name, values in zip(("file", "row", "n"), columns, strict=True)})

    table = rows.mapInArrow(count, _RUN).orderBy("file", "row").limit(RUNS + 1).toPandas()
    if len(table) > RUNS:
        raise ValueError("too many runs of rows: store the table in larger files")
    first = (table["n"].cumsum() - table["n"]).tolist()
    numbers = dict(zip(zip(table["file"].tolist(), table["row"].tolist(), strict=True), first, strict=True))
    return numbers | {(0, -1): int(table["n"].sum())}


def packed_records(rows: DataFrame, model_file: str, numbers: dict[tuple[int, int], int], key: int) -> DataFrame:
    """(shard, records): compressed records with their slots, by shard."""
    total = numbers[0, -1]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(model_file)
        at, before = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            file, row, begin = runs_of(batch)
            starts = set(begin.tolist())
            if before is not None and before[0] == file[0] and before[1] < row[0]:
                starts.discard(0)
            before = file[-1], row[-1]
            ids = batch.column("doc_id")
            has, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            for row_0, part, tokens, size in encoded(batch.column("text"), code):
                n = -(-size // LENGTH)
                index = np.empty(n.sum(), np.int64)
                owner = np.repeat(np.arange(part.n), n)
                seq = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                edges = sorted(b - row_0 for b in starts if row_0 <= b < row_0 + part.n)
                upto = np.concatenate(([0], np.cumsum(n)))
                for a, b in zip([0, *edges], [*edges, part.n], strict=True):
                    if a in edges:
                        at = numbers[int(file[row_0 + a]), int(row[row_0 + a])]
                    index[upto[a]:upto[b]] = at + np.arange(upto[b] - upto[a])
                    at += int(upto[b] - upto[a])
                records = np.zeros(len(owner), HEAD)
                records["doc_id"], records["has_id"] = ids[row_0 + owner], has[row_0 + owner]
                records["seq"] = seq
                records["n_tokens"] = np.minimum(LENGTH, size[owner] - seq * LENGTH)
                place = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
                flat = np.zeros(len(owner) * LENGTH, np.uint16)
                flat[np.repeat((np.cumsum(n) - n) * LENGTH, size) + place] = tokens
                records["ids"] = flat.reshape(-1, LENGTH)
                slot = permuted(index, total, key)
                shard = slot // RECORDS
                order = np.argsort(shard, kind="stable")
                shards, first = np.unique(shard[order], return_index=True)
                blobs = [pa.compress((slot[mine] % RECORDS).astype("<u4").tobytes() + records[mine].tobytes(),
                                     codec="zstd", asbytes=True) for mine in np.split(order, first[1:])]
                lengths = np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_pydict({"shard": shards, "records": pa.array([
                    int(k).to_bytes(4, "little") + blob for k, blob in zip(lengths, blobs, strict=True)], pa.binary())})

    return rows.mapInArrow(pack, _PACKED)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    raw = pa.decompress(blob[4:], decompressed_size=n * (4 + STRIDE), codec="zstd", asbytes=True)
    return np.frombuffer(raw, "<u4", n), np.frombuffer(raw, HEAD, n, 4 * n)


def write_shards(docs: DataFrame, store: Store, model_file: str, key: int = KEY) -> DataFrame:
    """Writes all shards, returns their manifest. Executors need the model file at that path."""
    rows = located_rows(docs, store)
    numbers = sequence_numbers(rows, model_file)
    total, folder = numbers[0, -1], store.folder("shards")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, records, filled = -1, None, 0

        def finish() -> pa.RecordBatch:
            n = min(RECORDS, total - current * RECORDS)
            if filled != n:
                raise RuntimeError(f"shard {current} has {filled} of {n} records")
            data, path = memoryview(records[:n].view(np.uint8)), f"{folder}/shard-{current:08d}.bin"
            write_whole(path, [data])
            return pa.RecordBatch.from_pydict({
                "shard": [current], "path": [path], "first_slot": [current * RECORDS],
                "n_records": [n], "crc": [zlib.crc32(data)]})

        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("records"), strict=True):
                if shard != current:
                    if records is not None:
                        yield finish()
                    records = None   # before the next one is made
                    current, records, filled = shard, np.zeros(RECORDS, HEAD), 0
                place, mine = unpacked(blob.as_py())
                records[place] = mine
                filled += len(place)
        if records is not None:
            yield finish()

    packed = packed_records(rows, model_file, numbers, key)
    # A shard is a range of slots; its number is its partition, so no sampling pass has to find ranges.
    parts = max(1, -(-total // RECORDS))
    dealt = packed.repartitionById(parts, F.col("shard").cast("int")).sortWithinPartitions("shard")
    return store.write(dealt.mapInArrow(write, MANIFEST))


def read_shards(manifest: DataFrame, first_slot: int = 0, step: int = 4096) -> DataFrame:
    """One row per record from ``first_slot`` on, read in order by byte range."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_ranges(row["path"]) as source:
                    at = max(0, first_slot - row["first_slot"])
                    while at < row["n_records"]:
                        n = min(step, row["n_records"] - at)
                        records = np.frombuffer(source.read_at(n * STRIDE, at * STRIDE), HEAD)
                        yield pa.RecordBatch.from_pydict({
                            "slot": row["first_slot"] + at + np.arange(n),
                            "shard": np.full(n, row["shard"]),
                            "doc_id": pa.array(records["doc_id"].astype(np.int64), mask=records["has_id"] == 0),
                            "seq": records["seq"].astype(np.int32),
                            "n_tokens": records["n_tokens"].astype(np.int32),
                            "crc": pa.array([zlib.crc32(r["ids"][:r["n_tokens"]].tobytes()) for r in records], pa.int64())})
                        at += n

    wanted = with_package(manifest).filter(F.col("first_slot") + F.col("n_records") > first_slot)
    # The shards left follow each other, so each gets a task of its own.
    parts = max(1, wanted.count())
    return wanted.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).mapInArrow(read, SEQUENCES)
