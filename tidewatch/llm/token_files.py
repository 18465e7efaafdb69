"""Token ids in files: one zstandard frame for each document, one dictionary for all.

A file set is a folder with two tables. `blocks` has rows of consecutive
documents: their ids, how many tokens each has, where each frame ends, the frames
themselves, the number of tokens before the block in its part, and the hash of
the dictionary. `dictionary` has the dictionary and its hash. A document is read
by cutting its frame out of its block; no other frame is touched.
"""

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm.sampling import at_most
from tidewatch.llm.tables import map_batches
from tidewatch.llm.tokens import behind, encoder, in_order, steps
from tidewatch.session import ship_package

BLOCK_BYTES = 1 << 20
PIECE_BYTES = 4096
PIECES = 8
BLOCKS = (
    "part int, block int, start long, n_tokens long, width int, dictionary string, "
    "doc_ids array<{kind}>, tokens array<long>, ends array<long>, frames binary"
)


def serialized(ids: np.ndarray, width: int) -> bytes:
    """Little-endian ids of 2 or 4 bytes."""
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> list[np.ndarray]:
    """Each document's ids with the end id behind them."""
    return [np.append(part, np.uint32(end_id)) for part in np.split(ids, np.cumsum(counts)[:-1])]


def id_bytes(tokenizer: str, end_id: int) -> int:
    """The bytes, 2 or 4, that hold every id of the vocabulary and the end id."""
    greatest = max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values())
    if end_id < 0 or greatest >= 1 << 32:
        raise ValueError("ids are unsigned numbers of at most 32 bits")
    return 2 if greatest < 1 << 16 else 4


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int, samples: int, size: int) -> bytes:
    """A dictionary trained on the serialized ids of about `samples` documents.

    At most eight pieces of 4 KB of a document reach the driver. Too little to
    train on makes the pieces themselves the dictionary; none, an empty one.
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = []
        for _, texts in steps(batch):
            for ids in with_end(*encoder(tokenizer).encode(texts), end_id):
                data = serialized(ids, width)
                starts = range(0, len(data), PIECE_BYTES)
                pieces += [data[start : start + PIECE_BYTES] for start in starts[:: -(-len(starts) // PIECES)]]
        return pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary())], ["piece"])

    chosen = at_most(docs.select("doc_id", "text"), ["doc_id", "text"], samples)
    pieces = sorted(row["piece"] for row in map_batches(chosen.select("text"), cut, "piece binary").toLocalIterator())
    if sum(map(len, pieces)) > 8 * size:
        try:
            return zstandard.train_dictionary(size, [bytes(piece) for piece in pieces]).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(map(bytes, pieces))[:size]


def write(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    width: int | None = None,
    samples: int = 2000,
    dictionary_bytes: int = 65536,
) -> None:
    """Write a file set in ascending order of the key.

    `samples` bounds the documents that the dictionary is trained on; all are
    encoded. `width` is the bytes of an id, 2 or 4: by default the least that holds all
    ids of the vocabulary and the end id; a width that does not is an error. A null text
    is the empty one; null keys come first; repeated rows are written as often as they
    occur. An empty table gives a file set without documents.
    """
    spark = docs.sparkSession
    ship_package(spark)
    least = id_bytes(tokenizer, end_id)
    width = least if width is None else width
    if width not in (2, 4) or width < least:
        raise ValueError(f"ids of this vocabulary need {least} bytes, not {width}")
    rows = in_order(docs, key, text)
    given = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dictionary = train_dictionary(given, tokenizer, end_id, width, samples, dictionary_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()
    schema = BLOCKS.format(kind=docs.schema[key].dataType.simpleString())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        compress = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).compress
        start = block = 0
        ids: list = []
        tokens: list[int] = []
        frames: list[bytes] = []

        def done() -> pa.RecordBatch:
            columns = [
                pa.array([part], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([start], pa.int64()),
                pa.array([sum(tokens)], pa.int64()),
                pa.array([width], pa.int32()),
                pa.array([digest]),
                pa.array([ids], pa.list_(kind)),
                pa.array([tokens], pa.list_(pa.int64())),
                pa.array([np.cumsum([len(frame) for frame in frames])], pa.list_(pa.int64())),
                pa.array([b"".join(frames)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, [column.split(" ")[0] for column in schema.split(", ")])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part_rows, texts in steps(batch):
                parts = with_end(*encoder(tokenizer).encode(texts), end_id)
                for doc_id, doc in zip(part_rows.column("doc_id").to_pylist(), parts, strict=True):
                    ids.append(doc_id)
                    tokens.append(len(doc))
                    frames.append(compress(serialized(doc, width)))
                if sum(map(len, frames)) >= BLOCK_BYTES:
                    yield done()
                    start, block = start + sum(tokens), block + 1
                    ids, tokens, frames = [], [], []
        if ids:
            yield done()

    rows.mapInArrow(pack, schema).write.option("compression", "none").parquet(f"{folder}/blocks")
    spark.createDataFrame([(digest, bytearray(dictionary))], "hash string, dictionary binary").write.parquet(
        f"{folder}/dictionary"
    )


def decoded(
    spark: SparkSession, folder: str, keys: list | None, columns: str, of_documents: Callable[[list[np.ndarray]], list[pa.Array]]
) -> DataFrame:
    """`doc_id`, `start` and what `of_documents` makes of the ids, from a file set's frames."""
    ship_package(spark)
    blocks = spark.read.parquet(f"{folder}/blocks")
    stored = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary, digest = bytes(stored["dictionary"]), stored["hash"]
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError(f"{folder}: the dictionary is not the one that was written")
    before = behind(blocks, "part", "n_tokens", "before")
    wanted = None if keys is None else set(keys)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    if keys is not None:
        blocks = blocks.where(F.arrays_overlap("doc_ids", F.array(*map(F.lit, keys)).cast(f"array<{kind}>")))
    names = ["doc_id", "start", *(column.split(" ")[0] for column in columns.split(", "))]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress
        for batch in batches:
            key_type = batch.schema.field("doc_ids").type.value_type
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names if name != "frames"}
                frames = memoryview(batch.column("frames")[at].as_buffer())
                if row["dictionary"] != digest:
                    raise ValueError(f"{folder}: a block of another dictionary")
                order = "<u2" if row["width"] == 2 else "<u4"
                starts = row["before"] + row["start"] + np.cumsum([0, *row["tokens"]])
                ends = [0, *row["ends"]]
                chosen = [i for i, doc_id in enumerate(row["doc_ids"]) if wanted is None or doc_id in wanted]
                for first in range(0, len(chosen), 256):
                    some = chosen[first : first + 256]
                    docs = [np.frombuffer(decompress(frames[ends[i] : ends[i + 1]]), order) for i in some]
                    keys_of = pa.array([row["doc_ids"][i] for i in some], key_type)
                    yield pa.RecordBatch.from_arrays([keys_of, pa.array(starts[some]), *of_documents(docs)], names)

    return blocks.join(F.broadcast(before), "part").mapInArrow(unpack, f"doc_id {kind}, start long, {columns}")


def read(spark: SparkSession, folder: str, keys: list | None = None) -> DataFrame:
    """`doc_id`, `start`, `ids` from a file set: all documents, or those with certain ids.

    `start` is the number of ids of all documents before. Only blocks that hold
    an asked id are read further, and only its frames are decompressed.
    """

    def ids(docs: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array([doc.astype(np.int32) for doc in docs], pa.list_(pa.int32()))]

    return decoded(spark, folder, keys, "ids array<int>", ids)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id`, `start`, `n_tokens`, `ids_crc32` of all documents, taken where their frames are read."""

    def digest(docs: list[np.ndarray]) -> list[pa.Array]:
        checks = [zlib.crc32(doc.astype("<u4").tobytes()) for doc in docs]
        return [pa.array([len(doc) for doc in docs], pa.int64()), pa.array(checks, pa.int64())]

    return decoded(spark, folder, None, "n_tokens long, ids_crc32 long", digest)
