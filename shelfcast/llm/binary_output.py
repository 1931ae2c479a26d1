"""Token ids as shuffled, compressed planes.

A file is one Spark partition of documents in ascending id order.  Each of its rows is a segment:
whole documents, their ids cut into blocks of a fixed number of ids.  A block is stored as byte
planes (all first bytes, all second bytes, ...) or bit planes, each compressed with zstandard.  The
row also holds the chunk index (ids before each block) and the document index (id and length).
Files are written by Spark, so they can go to any store it reaches, and a lost executor costs only
its unfinished files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfcast.llm import tokens
from shelfcast.llm.common import id_and_text, vocabulary

BLOCK_IDS = 65_536
SEGMENT_IDS = 524_288
FILE_SCHEMA = ("file int, segment int, start long, n_ids long, width int, plane string, "
               "doc_ids array<long>, doc_tokens array<long>, block_starts array<long>, "
               "blocks array<array<binary>>")
ARROW_SCHEMA = pa.schema([
    ("file", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()),
    ("width", pa.int32()), ("plane", pa.string()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_tokens", pa.list_(pa.int64())), ("block_starts", pa.list_(pa.int64())),
    ("blocks", pa.list_(pa.list_(pa.binary())))])


def to_planes(ids: np.ndarray, plane: str, level: int = 3) -> list[bytes]:
    """Transpose a block of unsigned 32-bit ids into compressed byte or bit planes."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if plane == "bit":
        raw = np.packbits(np.unpackbits(raw, axis=1).reshape(4, -1, 8), axis=1, bitorder="little")
        raw = np.ascontiguousarray(raw.transpose(0, 2, 1)).reshape(32, -1)
    pack = zstandard.ZstdCompressor(level=level)
    return [pack.compress(np.ascontiguousarray(row).tobytes()) for row in raw]


def from_planes(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    """The ids of a block of ``n``."""
    unpack = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(unpack.decompress(p), np.uint8) for p in planes]
    if plane == "bit":
        bits = np.stack([np.unpackbits(r, count=n, bitorder="little") for r in raw])
        raw = [np.packbits(bits[8 * k:8 * k + 8], axis=0)[0] for k in range(4)]
    return np.ascontiguousarray(np.stack(raw).T).view("<u4").reshape(-1)


def write_ids(docs: DataFrame, path: str, vocab: str | None = None, id_column: str = "doc_id",
              text_column: str = "text", plane: str = "byte", block_ids: int = BLOCK_IDS,
              segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text, append id 2, and write the ids in ascending id order.

    Null text is empty and has the end id alone.  A null document id sorts first; rows that
    repeat an id are separate documents next to each other, in order of their text.  An empty
    table writes files without segments.  Very long texts make a segment of their own.
    """
    vocab = vocab or vocabulary()

    def run(batches):
        from pyspark import TaskContext

        file, segment, start = TaskContext.get().partitionId(), 0, 0
        ids, sizes, held, n = [], [], [], 0

        def flush():
            joined = np.frombuffer(b"".join(held), "<u4")
            begins = list(range(0, len(joined), block_ids))
            blocks = [to_planes(joined[b:b + block_ids], plane) for b in begins]
            row = {"file": file, "segment": segment, "start": start, "n_ids": n, "width": 4,
                   "plane": plane, "doc_ids": ids, "doc_tokens": sizes, "block_starts": begins,
                   "blocks": blocks}
            return pa.RecordBatch.from_pylist([row], schema=ARROW_SCHEMA)

        for doc_id, got in tokens.encoded_batches(batches, vocab):
            ids.append(doc_id)
            sizes.append(len(got) // 4)
            held.append(got)
            n += sizes[-1]
            if n >= segment_ids:
                yield flush()
                segment, start = segment + 1, start + n
                ids, sizes, held, n = [], [], [], 0
        if ids:
            yield flush()

    # texts move once, as ranges of ids; each task then encodes and writes its range in order
    ordered = id_and_text(docs, id_column, text_column).repartitionByRange(
        "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILE_SCHEMA).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, sums: bool = False) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before it), n_tokens and the
    ids as little-endian unsigned 32-bit integers, or with ``sums`` their unsigned CRC instead
    (``ids_crc32``), formed where the ids are read."""
    last, kind = ("ids_crc32", pa.int64()) if sums else ("ids", pa.binary())

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                begins = [*row["block_starts"], row["n_ids"]]
                ids = np.concatenate([
                    from_planes(planes, begins[k + 1] - begins[k], row["plane"])
                    for k, planes in enumerate(row["blocks"])])
                ends = np.cumsum(row["doc_tokens"])
                begin = ends - row["doc_tokens"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(begin + row["start"] + row["before"], pa.int64()),
                    pa.array(row["doc_tokens"], pa.int64()),
                    pa.array([zlib.crc32(ids[a:b]) if sums else ids[a:b].tobytes()
                              for a, b in zip(begin, ends, strict=True)], kind)],
                    names=["doc_id", "start", "n_tokens", last])

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # one row per file, so a single window over them is as small as the list of files
    before = files.groupBy("file").agg(F.sum("n_ids").alias("n")).select(
        "file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return files.join(before, "file").mapInArrow(
        run, f"doc_id long, start long, n_tokens long, {last} {'long' if sums else 'binary'}")


def crc32(ids: DataFrame, *keep: str, width: int = 4) -> DataFrame:
    """Replace the column ``ids`` (little-endian ids of ``width`` bytes) by the unsigned CRC of the
    ids as 32-bit integers."""
    fields = [f for f in ids.select(*keep).schema]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def run(batches):
        for batch in batches:
            sums = pa.array([
                zlib.crc32(np.frombuffer(x.as_buffer(), f"<u{width}").astype("<u4").tobytes())
                for x in batch.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], sums], names=[*keep, "ids_crc32"])

    return ids.select(*keep, "ids").mapInArrow(run, f"{schema}, ids_crc32 long")
