"""Operator 6: token ids in a binary store, one zstandard frame per document under a shared dictionary.

A store is a folder of three Parquet tables, written and read by Spark only, so any file system will do:

* ``dictionary``: one row: the zstandard dictionary trained on serialised id arrays, its sha256, id width;
* ``frames``: a row per document in ascending doc_id order: shard, place in the shard, byte offset and
  length of the frame, ids before it in the shard, ids in it, the frame, the dictionary's hash;
* ``manifest``: a row per shard: first and last doc_id, documents, ids, ids in all shards before it.

The dictionary is trained on at most ``sample_docs`` documents (at most ``sample_bytes`` of each id array);
this bound touches compression only, never what is stored.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .byte_bpe import byte_characters
from .common import chunks, forget_at_exit, only, parts, shared_dir, table
from .pieces import PieceCache

END_ID = 0
#: A word of Latin letters, and a piece without white space, perhaps behind a blank.
LETTERS = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
WORD_PIECE = re.compile(r" ?\S+").fullmatch
FRAMES = "shard int, ordinal long, doc_id long, byte_offset long, byte_length int, local_start long, n_tokens long, frame binary, dict_sha256 string"


@lru_cache(maxsize=2)
def packer(tokenizer_path: str, width: int) -> PieceCache:
    import numpy as np

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path)
    kind = f"<u{width}"
    line_end = t.encode("\n", add_special_tokens=False).ids
    byte_letters = dict(enumerate(byte_characters()))
    # the shortcuts hold for byte-level vocabularies whose words get no prefix; others go through the library whole
    plain = len(line_end) == 1 and t.normalizer is None and str(t.pre_tokenizer) == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"

    def singly(pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, kind).tobytes() for e in t.encode_batch_fast(pieces, add_special_tokens=False)]

    def joined(pieces: list[str]) -> list[bytes]:
        """Pieces without line ends are encoded as the lines of one text: no token crosses a line end that stands alone."""
        ids = np.array(t.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, kind)
        ends = np.append(np.flatnonzero(ids == line_end[0]), len(ids))
        raw, starts = ids.tobytes(), np.append(0, ends[:-1] + 1)
        out = [raw[a:b] for a, b in zip((starts * width).tolist(), (ends * width).tolist())]
        return out if len(out) == len(pieces) else singly(pieces)

    def merged(pieces: list[str]) -> list[bytes]:
        """Words of letters are pre-tokens as they are: the library's model merges their bytes."""
        code, pack, tokens = {2: "H", 4: "I"}[width], struct.pack, t.model.tokenize
        out = []
        for p in pieces:
            ids = [x.id for x in tokens(p.encode().decode("latin-1").translate(byte_letters))]
            out.append(pack(f"<{len(ids)}{code}", *ids))
        return out

    def encode(pieces: list[str]) -> list[bytes]:
        if not plain:
            return singly(pieces)
        kinds = [0 if LETTERS(p) else 1 if WORD_PIECE(p) and "<|" not in p else 2 for p in pieces]
        done = [iter(f(x) if (x := [p for p, k in zip(pieces, kinds) if k == n]) else ()) for n, f in enumerate((merged, joined, singly))]
        return [next(done[k]) for k in kinds]

    return PieceCache(encode)


def id_width(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else 4


def _end(width: int) -> bytes:
    return END_ID.to_bytes(width, "little")


def train_dictionary(docs: DataFrame, tokenizer_path: str, width: int, *, dict_bytes: int = 65_536, sample_docs: int = 512, sample_bytes: int = 8_192) -> bytes:
    """The dictionary's bytes; empty when there is too little to learn from."""
    import zstandard

    def run(batches):
        import pyarrow as pa

        pack = packer(tokenizer_path, width).pack
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([(pack(t) + _end(width))[:sample_bytes] for t in b.column(0).to_pylist()], pa.binary())], ["ids"])

    # the rows of least hash, of all rows; a threshold leaves about four times as many to be ordered
    least = math.ceil(min(1.0, 4 * sample_docs / max(1, docs.count())) * (1 << 40))
    hashed = docs.where("text IS NOT NULL").select("text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 24).alias("h"))
    drawn = hashed.where(F.col("h") < least).orderBy("h").limit(sample_docs).select("text")
    rows = drawn.mapInArrow(run, "ids binary").collect()
    samples = [bytes(r.ids) for r in rows]
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:dict_bytes]


def write_store(docs: DataFrame, path: str, tokenizer_path: str, *, level: int = 3, shards: int | None = None) -> None:
    """Write the store of a table with doc_id and text.

    A null text is an empty document (the end id alone); null doc_ids come first; rows that share a doc_id
    are stored side by side, by text; other columns are ignored; an empty table gives an empty store.
    """
    spark = docs.sparkSession
    docs = only(docs, doc_id="long", text="string")
    width = id_width(tokenizer_path)
    dictionary = train_dictionary(docs, tokenizer_path, width)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, width, bytearray(dictionary))], "dict_sha256 string, id_width int, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        pack, end, shard = packer(tokenizer_path, width).pack_all, _end(width), TaskContext.get().partitionId()
        c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        k = offset = before = 0
        for b in batches:
            rows, ids = [], b.column(0).to_pylist()
            for at, texts in chunks(b.column(1), 8 << 20):
                for doc_id, raw in zip(ids[at : at + len(texts)], pack([t.decode() for t in texts])):
                    raw += end
                    frame, n = c.compress(raw), len(raw) // width
                    rows.append((shard, k, doc_id, offset, len(frame), before, n, frame, sha))
                    k, offset, before = k + 1, offset + len(frame), before + n
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()))], [x.split()[0] for x in FRAMES.split(", ")])

    n = shards or parts(spark)
    docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, FRAMES).write.option("compression", "none").parquet(f"{path}/frames")
    per_shard = spark.read.parquet(f"{path}/frames").groupBy("shard").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    # a row per shard: as many as there are write tasks, whatever the number of documents
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_shard.withColumn("start", before).coalesce(1).write.parquet(f"{path}/manifest")


def read_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids (packed as unsigned 32-bit integers) of all or the given documents.

    The given ids reach the scan as a filter, so that only row groups around them are read.
    """
    head = spark.read.parquet(f"{path}/dictionary").collect()[0]
    dictionary, width, sha = bytes(head.dictionary), head.id_width, head.dict_sha256
    if hashlib.sha256(dictionary).hexdigest() != sha:
        raise ValueError("the dictionary does not match its hash")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for b in batches:
            ids, crc = [], []
            for frame, of in zip(b.column("frame"), b.column("dict_sha256")):
                if of.as_py() != sha:
                    raise ValueError("a frame was written with another dictionary")
                raw = np.frombuffer(d.decompress(frame.as_py()), f"<u{width}").astype("<u4").tobytes()
                ids.append(raw)
                crc.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("doc_id"), b.column("local_start"), b.column("n_tokens"), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())], ["shard", "doc_id", "local_start", "n_tokens", "ids_crc32", "ids"])

    frames = spark.read.schema(FRAMES).parquet(f"{path}/frames")
    if doc_ids is not None:
        frames = frames.where(F.col("doc_id").isin([int(x) for x in doc_ids]))
    rows = frames.select("shard", "doc_id", "local_start", "n_tokens", "frame", "dict_sha256").mapInArrow(run, "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long, ids binary")
    starts = spark.read.parquet(f"{path}/manifest").select("shard", "start")
    return rows.join(F.broadcast(starts), "shard").select("doc_id", (F.col("start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    forget_at_exit(spark, path)
    return read_store(spark, path).drop("ids")
