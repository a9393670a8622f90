"""Token files coded by a static range asymmetric numeral system.

A file set is a folder of three tables. ``segments`` has one row per run of whole documents (about
``segment_tokens`` tokens; a document is never split over segments): its number in the order of the
key, the keys and lengths of its documents, and the coded image. ``table`` holds the shared symbol
frequencies, which sum to ``2 ** bits``; they come from counts over all documents. An image is a
sequence of blocks that decode independently of each other; a block interleaves ``lanes`` coders,
token ``i`` of the block going to lane ``i % lanes``, and starts with a checkpoint: the number of
tokens and words, the checksum of its words, the checksum of its tokens, and the state of each lane.

Coding is vectorised over all lanes of all blocks of a segment. States are 64-bit in
``[2**31, 2**63)`` and move one 32-bit word at a time.

Defined cases: a null text is empty and has its end id alone; null keys come first; rows with equal
keys are separate documents in order of a hash of their texts; an empty table gives an empty file set; damage in a block
raises ``ValueError`` when it is read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from probcast.llm.common import bounded_batches, text_slices
from probcast.llm.tokens import TextEncoder, with_end
from probcast.session import ensure_checkpoint_dir

LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
HEAD = struct.Struct("<4sIII")
BLOCK = struct.Struct("<IIII")


@dataclass(frozen=True)
class CodecOptions:
    bits: int = 18
    lanes: int = 256
    block_tokens: int = 1 << 16
    segment_tokens: int = 1 << 20


def quantised(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies proportional to the counts that sum to ``2 ** bits``; used symbols get at least 1."""
    total = 1 << bits
    used = np.flatnonzero(counts)
    if len(used) > total:
        raise ValueError(f"{len(used)} symbols do not fit a table of {total} slots")
    out = np.zeros(len(counts), np.uint64)
    if not len(used):
        return out
    share = counts[used] / counts[used].sum() * total
    freq = np.maximum(np.floor(share), 1).astype(np.int64)
    excess = int(freq.sum()) - total
    order = np.argsort(-freq, kind="stable")
    while excess > 0:  # taken from the most frequent symbols, where it costs least
        take = np.minimum(freq[order] - 1, np.maximum(freq[order] * excess // freq.sum(), 1))
        take = np.where(np.cumsum(take) <= excess, take, np.maximum(excess - np.cumsum(take) + take, 0))
        freq[order] -= take
        excess -= int(take.sum())
    freq[order[0]] -= excess
    out[used] = freq
    return out


class Codec:
    def __init__(self, freq: np.ndarray, options: CodecOptions):
        self.options = options
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.filler = int(np.argmax(freq)) if len(freq) else 0

    def _encode_blocks(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Lane states and words of blocks given as (block, step, lane)."""
        blocks, steps, lanes = ids.shape
        bits = np.uint64(self.options.bits)
        x = np.full((blocks, lanes), LOW)
        words = np.empty((steps, blocks, lanes), np.uint32)
        moved = np.empty((steps, blocks, lanes), bool)
        limit = self.freq << (np.uint64(63) - bits)
        for s in range(steps - 1, -1, -1):
            symbol = ids[:, s, :]
            f = self.freq[symbol]
            out = x >= limit[symbol]
            moved[s] = out
            words[s] = x.astype(np.uint32)
            x = np.where(out, x >> WORD, x)
            q = x // f
            x = (q << bits) + (x - q * f) + self.start[symbol]
        return [(x[b], words[:, b, :][moved[:, b, :]]) for b in range(blocks)]

    def encode(self, ids: np.ndarray) -> bytes:
        o = self.options
        n, per = len(ids), o.block_tokens
        full = n // per
        image = [HEAD.pack(b"RNS1", -(-n // per), o.lanes, n)]
        parts = []
        if full:
            parts += self._encode_blocks(ids[:full * per].reshape(full, per // o.lanes, o.lanes))
        if n % per:
            rest = ids[full * per:]
            steps = -(-len(rest) // o.lanes)
            padded = np.full(steps * o.lanes, self.filler, ids.dtype)
            padded[:len(rest)] = rest
            parts += self._encode_blocks(padded.reshape(1, steps, o.lanes))
        for b, (states, words) in enumerate(parts):
            own = ids[b * per:(b + 1) * per]
            raw = words.astype("<u4", copy=False).tobytes()
            image += [BLOCK.pack(len(own), len(words), zlib.crc32(raw),
                                 zlib.crc32(own.astype("<u4", copy=False).tobytes())),
                      states.astype("<u8", copy=False).tobytes(), raw]
        return b"".join(image)

    def blocks(self, image: bytes) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Checkpoints of an image: tokens, token checksum, lane states, words (checked)."""
        magic, count, lanes, _ = HEAD.unpack_from(image)
        if magic != b"RNS1" or lanes != self.options.lanes:
            raise ValueError("not a token image of this codec")
        at, out = HEAD.size, []
        for b in range(count):
            tokens, words, crc, crc_ids = BLOCK.unpack_from(image, at)
            at += BLOCK.size
            states = np.frombuffer(image, "<u8", lanes, at)
            at += 8 * lanes
            if zlib.crc32(image[at:at + 4 * words]) != crc:
                raise ValueError(f"block {b}: damaged words")
            out.append((tokens, crc_ids, states, np.frombuffer(image, "<u4", words, at)))
            at += 4 * words
        return out

    def decode_blocks(self, blocks: list[tuple[int, int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Ids of blocks with the same number of steps."""
        lanes = self.options.lanes
        steps = -(-blocks[0][0] // lanes)
        bits, mask = np.uint64(self.options.bits), np.uint64((1 << self.options.bits) - 1)
        x = np.stack([b[2] for b in blocks]).astype(np.uint64)
        pool = np.concatenate([*(b[3] for b in blocks), np.zeros(1, np.uint32)]).astype(np.uint64)
        sizes = np.array([len(b[3]) for b in blocks])
        at = np.cumsum(sizes) - sizes
        out = np.empty((steps, *x.shape), np.uint32)
        for s in range(steps):
            slot = x & mask
            symbol = self.symbol[slot]
            out[s] = symbol
            x = self.freq[symbol] * (x >> bits) + slot - self.start[symbol]
            need = x < LOW
            order = np.cumsum(need, axis=1)
            word = pool[np.minimum(at[:, None] + order - 1, len(pool) - 1)]
            x = np.where(need, (x << WORD) | word, x)
            at += order[:, -1]
        found = []
        for b, (tokens, crc, _, _) in enumerate(blocks):
            own = np.ascontiguousarray(out[:, b, :]).reshape(-1)[:tokens]
            if zlib.crc32(own.astype("<u4", copy=False).tobytes()) != crc:
                raise ValueError("decoded tokens do not match their checksum")
            found.append(own)
        return found

    def decode(self, image: bytes) -> np.ndarray:
        blocks = self.blocks(image)
        if not blocks:
            return np.zeros(0, np.uint32)
        full = [b for b in blocks if b[0] == self.options.block_tokens]
        parts = self.decode_blocks(full) if full else []
        for b in blocks[len(full):]:
            parts += self.decode_blocks([b])
        return np.concatenate(parts)


def _token_segments(docs: DataFrame, path: str, end: int, key: str, text: str, keep_spaces: bool,
                    segment_tokens: int) -> DataFrame:
    """Tokenised documents in key order, gathered into segments: part, segment, keys, lengths, ids."""
    ordered = docs.select(F.col(key).alias("id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    ordered = ordered.repartitionByRange("id", "_hash").sortWithinPartitions("id", "_hash")
    key_type = ordered.schema["id"].dataType.simpleString()

    def run(batches):
        encoder = TextEncoder(path, keep_spaces)
        part, number = TaskContext.get().partitionId(), 0
        keys, lengths, ids, size = [], [], [], 0

        def segment():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([pa.concat_arrays(keys).to_pylist()], pa.list_(keys[0].type)),
                 pa.array([np.concatenate(lengths)], pa.list_(pa.int64())),
                 pa.array([np.concatenate(ids).astype("<u4").tobytes()], pa.binary())],
                names=["part", "segment", "ids", "lengths", "tokens"])

        for batch in text_slices(batches, "_text"):
            found, bounds = with_end(*encoder.encode(batch.column("_text")), end)
            keys.append(batch.column("id"))
            lengths.append(np.diff(bounds))
            ids.append(found)
            size += len(found)
            if size >= segment_tokens:
                yield segment()
                keys, lengths, ids, size, number = [], [], [], 0, number + 1
        if keys:
            yield segment()

    return ordered.mapInArrow(
        run, f"part int, segment int, ids array<{key_type}>, lengths array<bigint>, tokens binary")


def _symbol_counts(segments: DataFrame) -> np.ndarray:
    """How often each symbol occurs in all segments; the driver gets one row per symbol."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for tokens in batch.column("tokens"):
                found = np.bincount(np.frombuffer(tokens.as_buffer(), "<u4"))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[:len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["symbol", "n"])

    rows = segments.select("tokens").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(
        F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["symbol"].max()) + 1 if len(rows) else 0, np.int64)
    counts[rows["symbol"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def write_token_files(docs: DataFrame, folder: str, path: str, end: int, key: str = "doc_id",
                      text: str = "text", keep_spaces: bool = False,
                      options: CodecOptions = CodecOptions()) -> None:
    """Tokenise whole texts in key order and write them to ``folder`` as a file set."""
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    staged = _token_segments(docs, path, end, key, text, keep_spaces, options.segment_tokens)
    staged.write.parquet(plain)
    segments = spark.read.schema(staged.schema).parquet(plain)
    freq = quantised(_symbol_counts(segments), options.bits)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq)], "symbol int, freq long").coalesce(1).write.parquet(
        f"{folder}/table")

    def run(batches):
        codec = Codec(freq, options)
        for batch in batches:
            tokens = [np.frombuffer(t.as_buffer(), "<u4") for t in batch.column("tokens")]
            yield (batch.drop_columns(["tokens"])
                   .append_column("n_tokens", pa.array([len(t) for t in tokens], pa.int64()))
                   .append_column("image", pa.array([codec.encode(t) for t in tokens], pa.binary())))

    schema = segments.drop("tokens").schema.add("n_tokens", "long").add("image", "binary")
    segments.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(f"{folder}/segments")
    files = spark._jvm.org.apache.hadoop.fs.Path(plain)
    files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, True)


def read_token_files(spark: SparkSession, folder: str, options: CodecOptions = CodecOptions(),
                     keep_tokens: bool = True) -> DataFrame:
    """Documents of a file set: id, start (ids of all documents before it), n_tokens, ids_crc32, and
    the ids as little-endian unsigned 32-bit integers."""
    table = spark.read.schema("symbol int, freq long").parquet(f"{folder}/table").orderBy("symbol").toPandas()
    freq = table["freq"].to_numpy(np.uint64)
    segments = spark.read.parquet(f"{folder}/segments")
    key_type = segments.schema["ids"].dataType.elementType.simpleString()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of keys
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("part", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inner"))
    placed = segments.join(starts.join(parts, "part").select(
        "part", "segment", (F.col("base") + F.col("inner")).alias("first")), ["part", "segment"])

    def run(batches):
        codec = Codec(freq, options)
        for batch in batches:
            for keys, lengths, image, first in zip(*(batch.column(c) for c in ("ids", "lengths", "image", "first"))):
                ids = codec.decode(image.as_py())
                sizes = np.array(lengths.as_py(), np.int64)
                if sizes.sum() != len(ids):
                    raise ValueError("a segment's tokens do not match its index")
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                cuts = list(zip((ends - sizes).tolist(), ends.tolist()))
                columns = [keys.values, pa.array(first.as_py() + ends - sizes), pa.array(sizes),
                           pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in cuts], pa.int64())]
                names = ["id", "start", "n_tokens", "ids_crc32"]
                if keep_tokens:
                    columns.append(pa.array([bytes(raw[4 * a:4 * b]) for a, b in cuts], pa.binary()))
                    names.append("tokens")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {key_type}, start long, n_tokens long, ids_crc32 long" + (", tokens binary" if keep_tokens else "")
    return placed.select("ids", "lengths", "image", "first").mapInArrow(run, schema)
