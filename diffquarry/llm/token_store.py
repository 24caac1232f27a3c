"""Token ids in ORC: stripes, run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import re
import uuid
import zlib
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, shared_dir, table

#: White space at which a text can't be cut without changing its pieces: two in a row, and all but spaces and line ends.
ODD_SPACE = ["  ", " \n", "\n ", "\n\n", *(chr(c) for c in range(0x10000) if chr(c).isspace() and chr(c) not in " \n")]
#: A word of plain Latin letters, then marks: two pieces for the tokenizer's own pattern.
WORD_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ſ]+)([!-&(-/:-@\[-`{-~]+)")
#: Letters of which a piece is one word for the tokenizer's pattern.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ſ]+")
#: The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on.
_PRINTABLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTE_CHARACTERS = [chr(b) if b in _PRINTABLE else chr(256 + b - sum(x < b for x in _PRINTABLE)) for b in range(256)]
#: Pieces that a worker remembers.
REMEMBERED = 1_000_000


class Pieces(dict):
    """Ids by piece, as little-endian uint32 bytes; lead is what stands before each key in the text.

    What was asked for last is kept: of REMEMBERED pieces at most, the older half goes when the newer is full.
    """

    def __init__(self, tokenizer, lead: str, marks: Pieces | None):
        self.tokenizer, self.lead, self.marks = tokenizer, lead, marks
        self.model, self.before = tokenizer.model, BYTE_CHARACTERS[32] if lead else ""
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if (made := self.older.pop(piece, None)) is not None:
            pass
        elif LETTERS.fullmatch(piece):  # one word, which the model alone cuts up
            word = piece if piece.isascii() else "".join(map(BYTE_CHARACTERS.__getitem__, piece.encode()))
            ids = [t.id for t in self.model.tokenize(self.before + word)]
            made = pack(f"<{len(ids)}I", *ids)
        elif m := WORD_MARKS.fullmatch(piece):
            made = self[m[1]] + (self if self.marks is None else self.marks)[m[2]]
        else:
            made = np.array(self.tokenizer.encode(self.lead + piece, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
        self[piece] = made
        return made


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, equal to those of one call for the whole text.

    The byte-level pattern always cuts before a single space and around a single line end, so pieces between them
    are encoded once and remembered. Texts with other white space, or with the string of an added token, which the
    tokenizer looks for first, go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.odd = [*ODD_SPACE, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content)]
        self.first = Pieces(self.tokenizer, "", None)
        self.later = Pieces(self.tokenizer, " ", self.first)
        self.line_end = self.first["\n"]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in self.odd):
            return self.whole(text)
        made, first, later = [], self.first, self.later.__getitem__
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            made.append(first[head])
            made.extend(map(later, rest))
            made.append(self.line_end)
        made.pop()
        return b"".join(made)


def encoder(path: str) -> Encoder:
    """One encoder per worker process, see kept()."""
    if path not in kept():
        kept()[path] = Encoder(path)
    return kept()[path]


def _tokens(path: str, end_id: int, key: str, batch: int = 256):
    def batches(it):
        enc, end, before = encoder(path), np.array([end_id], "<u4").tobytes(), 0
        for b in it:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                made = [enc.encode(t or "") + end for t in part.column(1).to_pylist()]
                n = np.array([len(x) // 4 for x in made], np.int64)
                ends = np.cumsum(n)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(made), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(before + ends - n), pa.array(n), ids], names=[key, "before", "n", "ids"])
                before += int(ends[-1])

    return batches


def write_store(docs: DataFrame, to: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = 2, stripe_bytes: int = 16 << 20, rows_in_index: int = 1000) -> None:
    """Write docs as ORC files in ascending order of key, nulls first; each text is encoded whole, then end_id.

    Columns: key, before (ids before the row in its file), n, ids. Texts are dealt out by ranges of the key before they
    are encoded, so that each task encodes and writes one file and the larger ids are never shuffled. Equal keys stay
    together, ordered by text; file names ascend with the key. Null and empty texts have the end id alone; an empty
    table makes a store without rows. Other columns of docs are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    spread = docs.select(F.col(key), F.col(text)).repartitionByRange(key).sortWithinPartitions(key, text)
    made = spread.mapInArrow(_tokens(path, end_id, key), f"`{key}` {kind}, before long, n long, ids array<int>")
    (
        made.write.option("orc.bloom.filter.columns", key).option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", str(rows_in_index))
        .option("orc.stripe.size", str(stripe_bytes)).option("compression", "none").orc(to)
    )


def read_store(spark: SparkSession, at: str) -> DataFrame:
    """The rows of a store with start (ids of all rows before) in place of before.

    Files are split by stripes for reading. One sum for each file comes to the driver, never a row for each document.
    """
    rows = spark.read.orc(at).withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int"))
    offsets, before = [], 0
    for file, n in sorted((r["file"], r["n"]) for r in rows.groupBy("file").agg(F.sum("n").alias("n")).collect()):
        offsets.append((file, before))
        before += n
    based = rows.join(F.broadcast(spark.createDataFrame(offsets, "file int, base long")), "file")
    return based.withColumn("start", F.col("base") + F.col("before")).drop("file", "base", "before").withColumnRenamed("n", "n_tokens")


def with_crc(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32): unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def batches(it):
        for b in it:
            ids = b.column(3)
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "start", "n_tokens", "ids").mapInArrow(batches, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Write a store to the shared folder and read it back."""
    to = f"{shared_dir(docs.sparkSession)}/diffquarry/tokens-{uuid.uuid4().hex}"
    write_store(docs, to, path, key, text, end_id)
    return read_store(docs.sparkSession, to)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_crc(store(table(spark, sf_dir, "documents"), vocabulary()))


QUERIES = {"op6_token_store": op6_token_store}
ORACLE: dict[str, str] = {}
