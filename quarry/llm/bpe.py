"""Byte-level BPE encoding and decoding with a local rank file.

The ranks are read once on the driver (a vocabulary file: a few MB, refused above MAX_RANK_BYTES) and sent to the
executors as a broadcast; each Python worker builds one tiktoken encoder from them. Texts are encoded whole, without
special tokens. A long text is cut at safe boundaries first: before a space that stands between two letters the split
pattern always ends one match and begins another, so encoding the parts and joining the ids gives the ids of the whole,
while the encoder's working memory stays bounded by the part.

Null text counts as empty and gives no ids; repeated rows give repeated rows; an empty table gives an empty table;
a very long text without safe boundaries (no space between letters) is encoded in one part; other columns pass through
`encode` and `decode` untouched whatever their names, and a column named like the output is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import tidied

MAX_RANK_BYTES = 64 << 20
#: Characters in a part of a long text, about.
PART = 1 << 16
_SAFE = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
_built: dict[str, Codec] = {}


def parts(text: str, size: int = PART) -> list[str]:
    """`text` cut at safe boundaries into parts of at least `size` characters, where it has any."""
    if len(text) <= 2 * size:
        return [text]
    out, first = [], 0
    while len(text) - first > 2 * size and (cut := _SAFE.search(text, first + size)):
        out.append(text[first : cut.start()])
        first = cut.start()
    return [*out, text[first:]]


class Codec:
    """Encoder and decoder of one rank file; built once in a worker."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes_of = {i: b for b, i in table.items()}
        self.digits_of = {i: str(i) for i in self.bytes_of}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= 2 * PART:
            return self.encoding.encode_ordinary(text)
        return [i for part in parts(text) for i in self.encoding.encode_ordinary(part)]

    def decode(self, ids: list[int] | None) -> bytes:
        """The raw bytes; those of a partial character stay as they are."""
        return b"".join(map(self.bytes_of.__getitem__, ids or ()))


def codec(ranks: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _built:
        _built[key] = Codec(ranks, pattern)
    return _built[key]


def _send(spark: SparkSession, rank_path: str):
    with open(rank_path, "rb") as f:
        ranks = f.read(MAX_RANK_BYTES + 1)
    if len(ranks) > MAX_RANK_BYTES:
        raise ValueError(f"{rank_path} is larger than {MAX_RANK_BYTES} bytes")
    return spark.sparkContext.broadcast(ranks)


def _replace(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """`df` with the ids of its text as array<int>."""
    sent = _send(df.sparkSession, rank_path)
    keep = [c for c in df.columns if c != out]

    def work(batches):
        tool = codec(sent.value, pattern)
        for batch in batches:
            ids = [tool.encode(x) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32()))], names=[*keep, out])

    return df.mapInArrow(work, _replace(df.schema, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """`df` with the raw bytes that its ids stand for."""
    sent = _send(df.sparkSession, rank_path)
    keep = [c for c in df.columns if c != out]

    def work(batches):
        tool = codec(sent.value, pattern)
        for batch in batches:
            data = [tool.decode(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary())], names=[*keep, out])

    return df.mapInArrow(work, _replace(df.schema, out, T.BinaryType()))


def digest(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids and of the decoded bytes (one pass, no shuffle)."""
    sent = _send(docs.sparkSession, rank_path)

    def work(batches):
        tool = codec(sent.value, pattern)
        digits = tool.digits_of.__getitem__
        for batch in batches:
            n, ids_sha, back_sha = [], [], []
            for text in batch.column(1):
                ids = tool.encode(text.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest())
                back_sha.append(hashlib.sha256(tool.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(work), schema)
