"""Token ids in files of a static range asymmetric numeral system (rANS).

File: MAGIC, then segments. A segment holds whole documents and stands alone:
  its header (JSON, zlib): document ids and token counts, the frequency table all its blocks share, and per block the
  number of ids, of steps between checkpoints, the place of its bytes and their CRC-32;
  its blocks: LANES interleaved coders; the first states, the states and stream position at every CHECKPOINT-th step,
  and the shared stream of 32-bit words.
Blocks need nothing but the segment's table, and a block can be entered at any of its checkpoints, so segments, blocks
and checkpoints all decode in parallel. Frequencies are scaled to 2**SCALE; states live in [2**31, 2**63).

Nulls: a null text is an empty document (just the end id); a null doc_id sorts first and is kept. Repeated doc_ids are
separate documents, in the order of their text. Empty tables give no files and no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import by_bytes, give_back, materialize, open_in, open_out, shared_dir, table

MAGIC = b"RANSTOK1"
LANES, BLOCK, CHECKPOINT, SCALE = 1024, 1 << 19, 128, 20
#: Ids after which a segment ends.
SEGMENT = 4_000_000
_LOW = np.uint64(1 << 31)


def frequencies(ids: np.ndarray, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, their frequencies adding up to 2**scale, each at least 1)."""
    ordered = np.sort(ids)
    at = np.flatnonzero(np.append(ordered[:1] == ordered[:1], ordered[1:] != ordered[:-1]))
    symbols, counts = ordered[at], np.diff(np.append(at, len(ordered)))
    if len(symbols) > 1 << scale:
        raise ValueError("more distinct ids than the scale has slots")
    freq = np.maximum(1, np.floor(counts * ((1 << scale) / counts.sum()))).astype(np.int64)
    over = int(freq.sum()) - (1 << scale)
    for k in np.argsort(-freq, kind="stable"):
        if over <= 0:
            break
        take = min(over, int(freq[k]) - 1)
        freq[k] -= take
        over -= take
    freq[np.argmax(freq)] -= min(over, 0)
    return symbols.astype(np.uint32), freq.astype(np.uint32)


class Table:
    """What coding needs of a frequency table."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray, scale: int = SCALE):
        self.symbols, self.scale = symbols, np.uint64(scale)
        self.freq = freq.astype(np.uint64)
        self.begin = np.cumsum(self.freq, dtype=np.uint64) - self.freq
        self.limit = self.freq << np.uint64(63 - scale)
        self.slot = None

    def slots(self) -> np.ndarray:
        if self.slot is None:
            self.slot = np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freq.astype(np.int64))
        return self.slot


def encode_block(codes: np.ndarray, t: Table, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    """codes: places in t.symbols. Id i goes to lane i % lanes at step i // lanes; coding runs from the last step back."""
    n, steps = len(codes), -(-len(codes) // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    held = 0
    for step in range(steps - 1, -1, -1):
        c = codes[step * lanes : (step + 1) * lanes]
        x = state[: len(c)]
        f = t.freq[c]
        full = x >= t.limit[c]
        if full.any():
            out = x[full]
            words.append(out.astype(np.uint32))
            held += len(out)
            x[full] = out >> np.uint64(32)
        q = x // f
        x[:] = (q << t.scale) + (x - q * f) + t.begin[c]
        if step and step % every == 0:
            marks.append((held, state.copy()))
    total = held
    marks.reverse()
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    head = struct.pack("<IIIII", n, lanes, every, len(marks), total)
    return b"".join([head, state.astype("<u8").tobytes(), *(struct.pack("<I", total - at) + s.astype("<u8").tobytes() for at, s in marks), stream.astype("<u4").tobytes()])


def decode_block(data: bytes, t: Table, first: int = 0) -> np.ndarray:
    """The codes of a block from checkpoint `first` on (0: all of it)."""
    n, lanes, every, marks, total = struct.unpack_from("<IIIII", data)
    at = 20
    if first:
        if first > marks:
            raise ValueError("no such checkpoint")
        at += 8 * lanes + (first - 1) * (4 + 8 * lanes)
        position = struct.unpack_from("<I", data, at)[0]
        state = np.frombuffer(data, "<u8", lanes, at + 4).copy()
    else:
        position, state = 0, np.frombuffer(data, "<u8", lanes, at).copy()
    stream = np.frombuffer(data, "<u4", total, len(data) - 4 * total)
    slots, mask = t.slots(), np.uint64((1 << int(t.scale)) - 1)
    start = first * every
    out = np.empty(n - min(n, start * lanes), np.uint32)
    for step in range(start, -(-n // lanes)):
        size = min(lanes, n - step * lanes)
        x = state[:size]
        low = x & mask
        c = slots[low]
        out[(step - start) * lanes : (step - start) * lanes + size] = c
        x[:] = t.freq[c] * (x >> t.scale) + low - t.begin[c]
        need = np.flatnonzero(x < _LOW)
        if len(need):
            x[need] = (x[need] << np.uint64(32)) | stream[position : position + len(need)]
            position += len(need)
    if first == 0 and (position != total or np.any(state != _LOW)):
        raise ValueError("a block does not end where it should")
    return out


def encode_segment(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    symbols, freq = frequencies(ids) if len(ids) else (np.zeros(0, np.uint32), np.zeros(0, np.uint32))
    t = Table(symbols, freq)
    codes = np.searchsorted(symbols, ids).astype(np.uint32)
    blocks = [encode_block(codes[k : k + BLOCK], t, min(LANES, max(1, len(codes) // 16))) for k in range(0, len(codes), BLOCK)]
    pack = lambda a: zlib.compress(a.astype("<u4").tobytes(), 1).hex()
    head = zlib.compress(json.dumps({"docs": doc_ids, "counts": pack(counts), "symbols": pack(np.diff(symbols, prepend=np.uint32(0))), "freq": pack(freq), "blocks": [[len(b), zlib.crc32(b)] for b in blocks]}).encode(), 1)
    return struct.pack("<II", len(head), zlib.crc32(head)) + head + b"".join(blocks)


def decode_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, their numbers of ids, all ids); raises ValueError where a checksum does not hold."""
    size, crc = struct.unpack_from("<II", data)
    head = data[8 : 8 + size]
    if zlib.crc32(head) != crc:
        raise ValueError("a segment's header is damaged")
    h = json.loads(zlib.decompress(head))
    open_ = lambda s: np.frombuffer(zlib.decompress(bytes.fromhex(s)), "<u4")
    t = Table(np.cumsum(open_(h["symbols"]), dtype=np.uint32), open_(h["freq"]))
    at, found = 8 + size, []
    for n, crc in h["blocks"]:
        block = data[at : at + n]
        if zlib.crc32(block) != crc:
            raise ValueError("a block is damaged")
        found.append(t.symbols[decode_block(block, t)])
        at += n
    return h["docs"], open_(h["counts"]).astype(np.int64), np.concatenate(found) if found else np.zeros(0, np.uint32)


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, kind: str = "word", partitions: int | None = None) -> DataFrame:
    """Encode doc_id, text in ascending doc_id order; one file per range of doc_ids.

    Returns a row per segment: file (its number in the order of doc_ids), segment, path, begin, length, n_tokens. Files
    that a lost task left behind are in no row.
    """
    spark = docs.sparkSession
    n = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import PieceEncoder

        encoder, number = PieceEncoder.of(tokenizer_path, kind), TaskContext.get().partitionId()
        path = stream = None
        rows: list[tuple] = []
        doc_ids: list = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []
        at = size = 0

        def flush() -> None:
            nonlocal at, size
            data = encode_segment(doc_ids, np.concatenate(counts), np.concatenate(held))
            stream.write(data)
            rows.append((number, len(rows), path, at, len(data), size))
            at += len(data)
            size = 0
            for x in (doc_ids, counts, held):
                x.clear()

        for batch in by_bytes(batches, "text", 4 << 20):
            if stream is None:
                path, stream = open_out(folder, f"ids-{number:06d}-{uuid.uuid4().hex[:8]}.rans")
                stream.write(MAGIC)
                at = len(MAGIC)
            ids, each = encoder.encode(batch.column("text"))
            full = np.insert(ids, np.cumsum(each), np.uint32(end_id))
            doc_ids += batch.column("doc_id").to_pylist()
            counts.append(each + 1)
            held.append(full)
            size += len(full)
            if size >= SEGMENT:
                flush()
        if stream is not None:
            if size:
                flush()
            stream.close()
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["file", "segment", "path", "begin", "length", "n_tokens"])

    return ordered.mapInArrow(write, "file int, segment int, path string, begin long, length long, n_tokens long")


def read_ids(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """Decode every segment; per document doc_id, start, n_tokens, ids_crc32 and, if asked, ids.

    The running total of segments is taken over the list of segments, which holds a row per some million ids.
    """
    spark = segments.sparkSession
    begun = F.coalesce(F.sum("n_tokens").over(Window.orderBy("file", "segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    listed = segments.select("path", "begin", "length", begun).repartition(max(2, spark.sparkContext.defaultParallelism), "path", "begin")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_in(row["path"]) as f:
                    f.seek(row["begin"])
                    docs, counts, ids = decode_segment(f.read(row["length"]))
                ids = ids.astype("<u4")
                raw, ends = memoryview(ids).cast("B") if len(ids) else memoryview(b""), np.cumsum(counts)
                begins = ends - counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [pa.array(docs, pa.int64()), pa.array(begins + row["base"], pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return listed.mapInArrow(read, schema)


def op3_rans_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark, "rans")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    segments = materialize(write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1), "rans-segments")
    return read_ids(segments)


QUERIES = {"op3_rans_token_store": op3_rans_token_store}
ORACLE_SQL: dict[str, str] = {}
