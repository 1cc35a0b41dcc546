"""Token-id output: one shared zstandard dictionary, each document its own frame.

The file format is a folder of three tables that Spark writes and commits:

* ``dictionary``: one row, ``dict_hash`` (sha256 of the dictionary),
  ``dictionary``, ``id_bytes`` (2 or 4, little-endian unsigned).
* ``blocks``: runs of documents in ascending ``doc_id`` (null first). ``shard``
  and ``block`` number them; ``doc_ids``, ``starts`` (ids of the shard's
  documents before), ``n_tokens`` and ``offsets`` (of the frames, with the end)
  are the index; ``frames`` are the compressed id arrays one after the other.
* ``shards``: ``shard``, ``base`` (ids in all shards before it), ``tokens``.

A short document is read by its block (``first_doc_id`` and ``last_doc_id``
have parquet statistics), its offset and the dictionary: no other frame is
decompressed.

Nulls and edges: a null text is the empty text, which has the end id alone. A
row with a null ``doc_id`` comes first. Rows that share a ``doc_id`` keep their
own frames, in the order of their texts' crc32 and length. An empty table gives
empty tables. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.llm import common
from codexflow.llm.encode import END_ID, WORD, column, encoder, tokenizer_path

#: Bytes of frames or documents after which a block ends.
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 2048

_FRAMES = "shard int, doc_id long, n_tokens long, order_key long, frame binary"
_BLOCKS = (
    "shard int, block int, first_doc_id long, last_doc_id long, dict_hash string, tokens long, "
    "doc_ids array<long>, starts array<long>, n_tokens array<long>, offsets array<long>, frames binary"
)
_DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"


@dataclass(frozen=True)
class TokenFiles:
    """Where the three tables are."""

    path: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def train_dictionary(documents: DataFrame, path: str, name: str, sample_docs: int = 2000, size: int = 65536) -> bytes:
    """A zstandard dictionary from the id arrays of about ``sample_docs`` documents.

    The sample is bounded: documents by a hash of their id, at most twice
    ``sample_docs`` of them and 4096 characters of each, from a place in the
    text that a hash of it tells. It only shapes the
    compression; every document is stored whole. With too few documents to
    train on, the dictionary is the plain concatenation of the sample.
    """
    every = max(1, documents.count() // sample_docs)
    text = common.text_or_empty()
    place = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - 4095, F.lit(1))).cast("int") + 1
    some = (
        documents.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
        .select(F.substring(text, place, F.lit(4096)).alias("text"))
        .limit(2 * sample_docs)
    )

    def encode(batches):
        e = encoder(path, name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([e.encode(t) for t in column(batch, "text")], pa.binary())], ["ids"])

    samples = [bytes(r.ids) for r in some.mapInArrow(encode, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, samples, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or bytes([END_ID, 0, 0, 0, 0, 0, 0, 0])


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def write_token_files(documents: DataFrame, path: str | None = None, tokenizer: str = WORD, level: int = 3) -> TokenFiles:
    """Encode every whole text, end it with id 2 and write the format above.

    One shuffle: compressed frames go to shards by ``doc_id``, whose bounds
    come from approximate quantiles of that column alone. Null ids, and an id
    that fills several quantiles, have as many shards, told by the crc32 that
    orders the rows of an id.
    """
    spark = documents.sparkSession
    files = TokenFiles(path or common.scratch_path(spark, "tokens"))
    documents = documents.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))
    tokens = tokenizer_path(tokenizer)
    trained = train_dictionary(documents, tokens, tokenizer)
    dict_hash = hashlib.sha256(trained).hexdigest()
    id_bytes = encoder(tokens, tokenizer).dtype.itemsize
    shards = common.partitions(spark)
    cuts = [i / shards for i in range(1, shards)] or [0.5]
    found = documents.agg(F.percentile_approx("doc_id", cuts).alias("at"), F.count("*").alias("n"), F.count("doc_id").alias("named")).first()
    bounds = np.array(found["at"] or [0], np.int64)
    nulls = -(-shards * (found["n"] - found["named"]) // max(1, found["n"]))

    def shard_of(doc_id: int | None, crc: int) -> int:
        if doc_id is None:
            return crc * nulls >> 32
        low, high = np.searchsorted(bounds, doc_id, "left"), np.searchsorted(bounds, doc_id, "right")
        # Of an id that is a bound itself, all but the last of its shards hold nothing else above it.
        return nulls + int(low) + (crc * int(max(1, high - low)) >> 32)

    def to_frames(batches):
        e = encoder(tokens, tokenizer)
        end = np.array([END_ID], dtype=e.dtype).tobytes()
        pack = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(trained), write_content_size=True)
        for batch in batches:
            ids = column(batch, "doc_id")
            raw = [e.encode(t) + end for t in column(batch, "text")]
            crcs = [zlib.crc32(r) for r in raw]
            shard = [shard_of(d, c) for d, c in zip(ids, crcs)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard, pa.int32()),
                    pa.array(ids, pa.int64()),
                    pa.array([len(r) // id_bytes for r in raw], pa.int64()),
                    pa.array(crcs, pa.int64()),
                    pa.array([pack.compress(r) for r in raw], pa.binary()),
                ],
                ["shard", "doc_id", "n_tokens", "order_key", "frame"],
            )
        e.forget()

    def to_blocks(batches):
        shard, block, before, rows, held = None, 0, 0, [], 0

        def made():
            starts = before + np.concatenate([[0], np.cumsum([r[1] for r in rows])])
            offsets = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])])
            row = {
                "shard": shard, "block": block, "first_doc_id": rows[0][0], "last_doc_id": rows[-1][0],
                "dict_hash": dict_hash, "tokens": int(starts[-1]) - before, "doc_ids": [r[0] for r in rows],
                "starts": starts[:-1].tolist(), "n_tokens": [r[1] for r in rows], "offsets": offsets.tolist(),
                "frames": b"".join(r[2] for r in rows),
            }
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_SCHEMA), int(starts[-1])

        for batch in batches:
            for s, d, n, f in zip(*(column(batch, c) for c in ("shard", "doc_id", "n_tokens", "frame"))):
                if rows and (s != shard or held >= BLOCK_BYTES or len(rows) >= BLOCK_DOCS):
                    out, before = made()
                    yield out
                    block, rows, held = block + 1, [], 0
                if s != shard:
                    shard, block, before = s, 0, 0
                rows.append((d, n, f))
                held += len(f)
        if rows:
            yield made()[0]

    (
        documents.mapInArrow(to_frames, _FRAMES)
        .repartitionById(shards + nulls, F.col("shard"))
        .sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "order_key", "n_tokens", "frame")
        .mapInArrow(to_blocks, _BLOCKS)
        .write.option("compression", "none")
        .parquet(f"{files.path}/blocks")
    )
    # One row a shard: the bound is the number of shards, not the rows.
    totals = files.table(spark, "blocks").groupBy("shard").agg(F.sum("tokens").alias("tokens")).collect()
    base, rows = 0, []
    for r in sorted(totals):
        rows.append((r.shard, base, r.tokens))
        base += r.tokens
    spark.createDataFrame(rows, "shard int, base long, tokens long").coalesce(1).write.parquet(f"{files.path}/shards")
    spark.createDataFrame([(dict_hash, trained, id_bytes)], "dict_hash string, dictionary binary, id_bytes int").coalesce(1).write.parquet(f"{files.path}/dictionary")
    return files


_BLOCK_SCHEMA = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first_doc_id", pa.int64()), ("last_doc_id", pa.int64()), ("dict_hash", pa.string()), ("tokens", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("doc_ids", "starts", "n_tokens", "offsets")]
    + [("frames", pa.binary())]
)


def _opened(files: TokenFiles, spark: SparkSession) -> tuple[str, bytes, np.dtype]:
    d = files.table(spark, "dictionary").first()
    found = hashlib.sha256(d.dictionary).hexdigest()
    if found != d.dict_hash:
        raise ValueError(f"the dictionary's hash is {found}, not {d.dict_hash}")
    return d.dict_hash, bytes(d.dictionary), np.dtype(f"<u{d.id_bytes}")


def read_ids(files: TokenFiles, spark: SparkSession, doc_id: int) -> list[np.ndarray]:
    """The id arrays of one document, from its own frames alone."""
    dict_hash, trained, dtype = _opened(files, spark)
    near = files.table(spark, "blocks").filter((F.col("first_doc_id") <= doc_id) | F.col("first_doc_id").isNull()).filter(F.col("last_doc_id") >= doc_id)
    at = near.select("dict_hash", "n_tokens", "offsets", "frames", F.posexplode("doc_ids").alias("i", "doc_id")).filter(F.col("doc_id") == doc_id)
    cut = at.select("dict_hash", F.expr("n_tokens[i]").alias("n"), F.expr("substring(frames, cast(offsets[i] + 1 as int), cast(offsets[i + 1] - offsets[i] as int))").alias("frame"))
    unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(trained))
    found = cut.collect()
    if any(r.dict_hash != dict_hash for r in found):
        raise ValueError("a block was written with another dictionary")
    return [np.frombuffer(unpack.decompress(bytes(r.frame), max_output_size=r.n * dtype.itemsize), dtype) for r in found]


def read_documents(files: TokenFiles, spark: SparkSession) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32."""
    dict_hash, trained, dtype = _opened(files, spark)

    def unpacked(batches):
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(trained))
        for batch in batches:
            for r in batch.to_pylist():
                if r["dict_hash"] != dict_hash:
                    raise ValueError(f"block {r['shard']}/{r['block']} was written with another dictionary")
                crcs, counts, frames = [], [], memoryview(r["frames"])
                for i, n in enumerate(r["n_tokens"]):
                    raw = unpack.decompress(frames[r["offsets"][i] : r["offsets"][i + 1]], max_output_size=n * dtype.itemsize)
                    ids = np.frombuffer(raw, dtype).astype("<u4")
                    crcs.append(zlib.crc32(ids.tobytes()))
                    counts.append(len(ids))
                shard = pa.array([r["shard"]] * len(counts), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(r["starts"], pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), shard],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                )

    shards = files.table(spark, "shards").select("shard", "base")
    found = files.table(spark, "blocks").drop("first_doc_id", "last_doc_id", "tokens").mapInArrow(unpacked, _DOCUMENTS)
    # As many rows as shards.
    return found.join(F.broadcast(shards), "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(common.read(spark, sf_dir, "documents"))
    return read_documents(files, spark)
