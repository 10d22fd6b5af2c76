"""Operator 3: byte-level BPE encoding and decoding with a sentencepiece model built from a rank table.

Method: every byte is mapped to one printable character, every vocabulary entry becomes a piece of a
sentencepiece BPE model whose score is its negative rank, and normalisation is the identity. sentencepiece
then merges the best-scored (lowest-ranked) neighbours first, leftmost on ties, as rank-based BPE does.
The pre-tokens of a text are encoded one by one; decoding maps ids back through the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .common import chunks, give_back, only, table
from .pieces import PieceCache

#: Bytes of texts encoded together; no result depends on it. What encoding holds at a time is many times as much.
CHUNK = 2 << 20


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """A character for each byte: printable Latin-1 stays, the rest moves past U+00FF, so that no byte becomes white space."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value & 0xFFFFFFFFFFFFFFFF)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: an unknown piece at id 0, then the entries by rank, so that id = rank + 1.

    Ranks must be 0..n-1 without gaps and hold all 256 single bytes.
    """
    table_ = byte_characters()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be consecutive from 0")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"single bytes missing from the vocabulary: {missing[:5]}")
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _flag(3, kind))
    out = [piece("<unk>", 0.0, 2)]
    out += [piece("".join(table_[b] for b in t), -float(r), 1) for r, t in enumerate(by_rank)]
    trainer = _flag(3, 2) + _flag(4, len(by_rank) + 1) + _flag(40, 0) + _flag(41, -1) + _flag(42, -1) + _flag(43, -1)
    normalizer = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder over a rank table; ``pattern`` cuts texts into pre-tokens (regex module syntax)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks = ranks
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.find = regex.compile(pattern).findall
        self.spm = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.mapped = {b: c for b, c in enumerate(byte_characters())}
        self.cache = PieceCache(self._encode_pieces)

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        found = [self.find(p) for p in pieces]
        distinct = dict.fromkeys(t for tokens in found for t in tokens)
        long = []
        for t in distinct:
            raw = t.encode()
            if (whole := self.ranks.get(raw)) is not None:
                distinct[t] = struct.pack("<I", whole)
            else:
                long.append((t, raw.decode("latin-1").translate(self.mapped)))
        for (t, _), ids in zip(long, self.spm.encode([m for _, m in long], num_threads=1) if long else ()):
            distinct[t] = struct.pack(f"<{len(ids)}I", *[i - 1 for i in ids])
        return [b"".join([distinct[t] for t in tokens]) for tokens in found]

    def pack_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return self.cache.pack_all([t or "" for t in texts])

    def encode(self, text: str | None) -> list[int]:
        packed = self.pack_all([text])[0]
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, packed: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int): the token ids of each text."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = load(path, pattern)
        for b in batches:
            ids = [np.frombuffer(p, "<u4").astype("int32") for _, texts in chunks(b.column(1), CHUNK) for p in bpe.pack_all([t.decode() for t in texts])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes (binary): the inverse of ``encode``; null ids give no bytes."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = load(path, pattern)
        for b in batches:
            raw = [bpe.decode(np.asarray(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return only(encoded, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, digests ids_sha256 and decoded_sha256, round_trips, and on demand ids.

    Null and empty texts have no tokens; repeated rows give repeated results; a null doc_id stays null;
    columns besides doc_id and text are ignored. One narrow pass, no shuffle; the cache is bounded, and other
    memory is given back after each batch.
    """
    import pyarrow as pa

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trips boolean" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = load(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, back, same, kept = [], [], [], [], []
            for _, texts in chunks(b.column(1), CHUNK):
                for text, packed in zip(texts, bpe.pack_all([t.decode() for t in texts])):
                    raw = bpe.decode(packed)
                    n.append(len(packed) // 4)
                    ids.append(sha(packed))
                    back.append(sha(raw))
                    same.append(raw == text)
                    if keep_ids:
                        kept.append(np.frombuffer(packed, "<i4"))
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string()), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trips"]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            yield one(b)
            del b
            give_back()

    return only(docs, doc_id="long", text="string").mapInArrow(run, schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
