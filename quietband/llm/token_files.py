"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

A file holds the documents of one range of ids in ascending order. Ids are
replaced by their frequency rank over the whole corpus, so that most take one
byte; two bits per id in separate control bytes give its length (1 to 4 bytes),
four ids to a control byte, and every document starts at a control byte:

    magic, documents, ids, control bytes, data bytes   (five unsigned 64-bit)
    document ids (signed 64-bit), ids per document (unsigned 64-bit),
    NULL flags (bytes), control bytes, data bytes

``ranks.bin`` maps ranks back to ids (unsigned 32-bit). Texts are tokenized once:
ids are first kept per range in compressed scratch files while their frequencies
are counted, and each scratch file goes when its final file is in place. Files
appear under their final name only when complete, so a lost task is just repeated.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietband.llm.common import slices, stage_path, store
from quietband.llm.tokens import TEXT_BYTES, WordEncoder

MAGIC = 0x31304253564B5451
# Documents per range on average, and ranges at least.
RANGE_DOCS = 20_000
MIN_RANGES = 48
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode(values: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values, ``counts`` of them per document."""
    values = values.astype("<u4")
    size = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    blocks = -(-counts // 4)
    gaps = np.cumsum(blocks * 4 - counts) - (blocks * 4 - counts)  # unused places before each document
    padded = np.zeros(int(blocks.sum()) * 4, np.uint8)
    padded[np.arange(len(values)) + np.repeat(gaps, counts)] = size
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) <= size[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Values of documents with ``counts`` values each, lengths by table lookup."""
    blocks = -(-counts // 4)
    lengths = _LENGTHS[control].ravel()
    slot = np.arange(len(lengths)) - np.repeat((np.cumsum(blocks) - blocks) * 4, blocks * 4)
    lengths = lengths[slot < np.repeat(counts, blocks * 4)]
    first = np.cumsum(lengths) - lengths
    values = data[first].astype(np.uint32)
    for byte in range(1, 4):
        more = np.flatnonzero(lengths > byte)
        if not len(more):
            break
        values[more] |= data[first[more] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return values


class Folder:
    """Files below a URI, from any machine."""

    def __init__(self, uri: str):
        if uri.startswith("file:/") and not uri.startswith("file:///"):
            uri = "file://" + uri[len("file:") :]
        self.system, self.root = pafs.FileSystem.from_uri(uri)

    def exists(self, name: str) -> bool:
        return self.system.get_file_info(f"{self.root}/{name}").type == pafs.FileType.File

    def read(self, name: str) -> bytes:
        with self.system.open_input_stream(f"{self.root}/{name}") as source:
            return source.read()

    def write(self, name: str, content: bytes) -> None:
        """All or nothing; the last of several equal writers wins."""
        self.system.create_dir(self.root)
        half = f"{self.root}/.{name}-{uuid.uuid4().hex}"
        with self.system.open_output_stream(half) as sink:
            sink.write(content)
        self.system.move(half, f"{self.root}/{name}")

    def remove(self, name: str) -> None:
        if self.exists(name):
            self.system.delete_file(f"{self.root}/{name}")


def _bytes_of(parts: list[np.ndarray]) -> bytes:
    return b"".join(p.tobytes() for p in parts)


def _tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, bounds) -> DataFrame:
    """``(range, id, crc, ids)`` with ids as bytes; rows of one id may share several ranges."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, 1, TEXT_BYTES):
                end = np.array([end_id], encoder.dtype).tobytes()
                raws = [raw + end for raw in encoder.encode_raw([t or "" for t in part.column(1).to_pylist()])]
                crc = np.array([zlib.crc32(raw) for raw in raws], np.int64)
                ids = pa.compute.fill_null(part.column(0), np.iinfo(np.int64).min).to_numpy()
                low, high = np.searchsorted(bounds, ids), np.searchsorted(bounds, ids, "right")
                columns = [
                    pa.array(low + crc % (high - low + 1)),
                    part.column(0),
                    pa.array(crc),
                    pa.array(list(map(pack, raws)), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "id", "crc", "ids"])

    wanted = docs.select(F.col(id_col).cast("long").alias("id"), text_col)
    return wanted.mapInArrow(emit, "range long, id long, crc long, ids binary")


def _keep_ranges(folder_uri: str, vocabulary: int, width: int):
    """Write each range's documents to a scratch file; pass on how often each id occurs."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        folder, counts = Folder(folder_uri), np.zeros(vocabulary, np.int64)
        unpack = zstandard.ZstdDecompressor().decompress

        def close(name: int, docs: list) -> None:
            plain = b"".join(unpack(raw) for _, raw in docs)
            counts[:] += np.bincount(np.frombuffer(plain, f"<u{width}"), minlength=vocabulary)
            ids = np.array([i or 0 for i, _ in docs], "<i8")
            null = np.array([i is None for i, _ in docs], np.uint8)
            sizes = np.array([len(raw) for _, raw in docs], "<u8")
            head = np.array([len(docs)], "<u8")
            folder.write(f"ids-{name}", _bytes_of([head, ids, null, sizes]) + b"".join(raw for _, raw in docs))

        name, docs = None, []
        for batch in batches:
            for where, i, raw in zip(*[batch.column(k).to_pylist() for k in (0, 1, 3)]):
                if where != name:
                    if docs:
                        close(name, docs)
                    name, docs = where, []
                docs.append((i, raw))
        if docs:
            close(name, docs)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "n"])

    return keep


def _write_ranges(folder_uri: str, rank_of, width: int):
    """Turn scratch files into final ones; ``(range, documents, ids)``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        folder, unpack = Folder(folder_uri), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for name in batch.column(0).to_pylist():
                final = f"part-{name}.svb"
                if folder.exists(final):
                    folder.remove(f"ids-{name}")
                elif folder.exists(f"ids-{name}"):
                    folder.write(final, _final(folder.read(f"ids-{name}"), unpack))
                    folder.remove(f"ids-{name}")
                else:
                    continue
                head = np.frombuffer(folder.read(final)[:40], "<u8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], pa.int64()) for x in (name, int(head[1]), int(head[2]))],
                    names=["range", "docs", "ids"],
                )

    def _final(raw: bytes, unpack) -> bytes:
        count = int(np.frombuffer(raw, "<u8", 1)[0])
        ids = np.frombuffer(raw, "<i8", count, 8)
        null = np.frombuffer(raw, np.uint8, count, 8 + 8 * count)
        sizes = np.frombuffer(raw[8 + 9 * count : 8 + 17 * count], "<u8").astype(np.int64)
        ends = 8 + 17 * count + np.cumsum(sizes)
        plain = [unpack(raw[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
        lengths = np.array([len(p) // width for p in plain], np.int64)
        control, rest = encode(rank_of.value[np.frombuffer(b"".join(plain), f"<u{width}")], lengths)
        head = np.array([MAGIC, count, int(lengths.sum()), len(control), len(rest)], "<u8")
        return _bytes_of([head, ids, lengths.astype("<u8"), null]) + control + rest

    return write


def read_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, NULL flags, ids per document and the ranks of all ids of one file."""
    magic, docs, _, controls, rest = (int(x) for x in np.frombuffer(raw, "<u8", 5))
    if magic != MAGIC:
        raise ValueError("not a token file")
    ids = np.frombuffer(raw, "<i8", docs, 40)
    counts = np.frombuffer(raw, "<u8", docs, 40 + 8 * docs).astype(np.int64)
    null = np.frombuffer(raw, np.uint8, docs, 40 + 16 * docs)
    at = 40 + 17 * docs
    control = np.frombuffer(raw, np.uint8, controls, at)
    return ids, null, counts, decode(control, np.frombuffer(raw, np.uint8, rest, at + controls), counts)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write all texts to ``folder`` and return ``(range, docs, ids)``, one row per file.

    Ids ascend within and across files; NULL ids come first, rows of one id follow
    each other in an order fixed by their tokens. A NULL text is empty and gives the
    end id alone. An empty table writes no document file.
    """
    spark = docs.sparkSession
    encoder = WordEncoder.of(tokenizer)
    vocabulary, width = max(encoder.library.get_vocab_size(), end_id + 1), np.dtype(encoder.dtype).itemsize
    ranges = max(MIN_RANGES, docs.count() // RANGE_DOCS)
    probs = [i / ranges for i in range(1, ranges)]
    cuts = docs.select(F.percentile_approx(F.col(id_col).cast("long"), probs, 10 * ranges)).first()[0]
    bounds = np.array(cuts if cuts is not None else [0], np.int64)
    kept = (
        _tokenized(docs, id_col, text_col, tokenizer, end_id, bounds)
        .repartition(ranges, "range")
        .sortWithinPartitions("range", F.col("id").asc_nulls_first(), "crc")
        .mapInArrow(_keep_ranges(folder, vocabulary, width), "id long, n long")
    )
    counts = store(kept.groupBy("id").agg(F.sum("n").alias("n")), "counts").toPandas()  # one row per id in use
    order = counts["id"].to_numpy(np.int64)[np.lexsort((counts["id"], -counts["n"].to_numpy()))]
    rank_of = np.zeros(vocabulary, np.uint32)
    rank_of[order] = np.arange(len(order))
    Folder(folder).write("ranks.bin", order.astype("<u4").tobytes())
    shipped = spark.sparkContext.broadcast(rank_of)
    names = spark.range(0, len(bounds) + 1, 1, len(bounds) + 1)
    return store(names.mapInArrow(_write_ranges(folder, shipped, width), "range long, docs long, ids long"), "files")


def read_token_files(files: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, from the files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Folder(folder)
        id_of = np.frombuffer(place.read("ranks.bin"), "<u4")
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, null, counts, ranks = read_file(place.read(f"part-{name}.svb"))
                raw = id_of[ranks].astype("<u4")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(ends - counts, ends)]
                columns = [
                    pa.array(ids, mask=null.astype(bool)),
                    pa.array(before + ends - counts),
                    pa.array(counts),
                    pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "n_tokens", "ids_crc32"])

    before = F.sum("ids").over(Window.orderBy("range")) - F.col("ids")
    placed = files.select("range", before.alias("before"))  # one small row per file
    return placed.repartition(max(MIN_RANGES, files.count())).mapInArrow(
        read, f"{id_col} long, start long, n_tokens long, ids_crc32 long"
    )


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to a new folder in the shared place and read it back."""
    folder = stage_path(spark, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id), folder)
