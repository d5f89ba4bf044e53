"""Harmonic packing of token sequences into fixed-length training sequences.

Harmonic packing sorts lengths into classes by the reciprocal of the share of a sequence
they may take: class k holds what fits k times into the capacity, and every bin of class k
gets exactly k pieces, whatever other workers do. Documents may be cut, so each is cut at
capacity / k for k = 1, 2, 4, ...: whole sequences first, then the binary digits of the
rest. Pieces then fill their class's bins without a gap. The few pieces a worker has left
in a class (fewer than k) form bins of 2**j pieces, whose length is a power of two.

Defined results: NULL text is the empty text and gives one piece, the end id alone; rows
that repeat an id are packed like others; an empty table gives no rows. Only id and text
are read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenbar.llm.common import whole, workers_of

CAPACITY = 1024
END_ID = 0
#: Rows encoded at a time: bounds what a task holds besides the Arrow batch.
STEP = 64


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of ``n`` ids: full sequences, then the binary digits."""
    rest = n % capacity
    low = [1 << b for b in reversed(range(capacity.bit_length() - 1)) if rest >> b & 1]
    return [capacity] * (n // capacity) + low


#: tiktoken's pattern tries every end of a white-space run and panics on very long ones; a
#: text with a run of so many characters is encoded by tokenizers.
LONG_RUN = 10_000


def encoder(ranks_path: str, pattern: str):
    """Byte-level BPE with the same vocabulary and ids as the tokenizers file, about four
    times as fast; strings of special tokens in a text are ordinary text."""
    import base64

    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
    )


def encode_as_file(ranks_path: str, pattern: str, json_path: str, added_tokens: bool = True):
    """Function from text to the ids of the tokenizers file, without added ids around them.

    Strings of the file's added tokens become their ids, or are ordinary text without
    ``added_tokens``; what lies between them is encoded by tiktoken.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    slow.encode_special_tokens = not added_tokens
    ordinary = encoder(ranks_path, pattern).encode_ordinary
    added = {} if not added_tokens else {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    for t in slow.get_added_tokens_decoder().values():
        if t.lstrip or t.rstrip or t.single_word or t.normalized:
            return lambda text: slow.encode(text, add_special_tokens=False).ids
    names = sorted(added, key=len, reverse=True)
    split = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if added else None
    long_run = re.compile(rf"\s{{{LONG_RUN}}}").search

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_RUN and long_run(text):
            return slow.encode(text, add_special_tokens=False).ids
        if not any(name in text for name in names):
            return ordinary(text)
        ids = []
        for i, part in enumerate(split(text)):
            ids += [added[part]] if i % 2 else ordinary(part)
        return ids

    return encode


def public_vocabulary() -> tuple[str, str, str]:
    """(file of ranks, split pattern, tokenizers file) of the 50k byte-level vocabulary on
    this worker."""
    import public_tokenizers

    at = public_tokenizers.path
    return at("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, at("byte_bpe_50k.json")


def _pieces_of(vocabulary, capacity: int, with_ids: bool, added_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encode_as_file(*vocabulary(), added_tokens)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                out: list[list] = [[] for _ in range(6)]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text)
                    ids.append(END_ID)
                    start = 0
                    for length in cuts(len(ids), capacity):
                        piece = ids[start : start + length]
                        crc = zlib.crc32(struct.pack(f"<{length}I", *piece))
                        row = (doc, start, length, crc, len(ids), piece if with_ids else None)
                        for column, value in zip(out, row):
                            column.append(value)
                        start += length
                arrays = [pa.array(out[0], batch.schema.field(0).type)]
                arrays += [pa.array(c, pa.int64()) for c in out[1:5]]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays.append(pa.array(out[5], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary=public_vocabulary,
    with_ids: bool = False,
    added_tokens: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``vocabulary`` is called on the workers, where its files must lie. ``capacity`` is a
    power of two. Pieces are dealt by hash to as many workers as there are shuffle
    partitions; each fills the bins of each class by itself, after the one exchange.
    ``with_ids`` adds the ids of each piece. With ``added_tokens`` the ids are those of plain
    ``encode(text, add_special_tokens=False)`` of the tokenizers file; else strings of its
    added tokens are ordinary text (``encode_special_tokens``).
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    source = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    shape = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    shape += ", ids array<int>" if with_ids else ""
    pieces = source.mapInArrow(_pieces_of(vocabulary, capacity, with_ids, added_tokens), shape)
    worker = F.pmod(F.xxhash64("id", "start"), F.lit(workers_of(docs)))
    group = Window.partitionBy("worker", "length")
    turn = F.row_number().over(group.orderBy("id", "start")) - 1
    size = F.col("length")
    per_bin = (F.lit(capacity) / size).cast("long")
    filled = (F.col("n") / per_bin).cast("long") * per_bin
    # a left-over piece j of t lies in the bin of the highest binary digit in which j and t
    # differ: that digit is one of t's, and bins are laid out from the highest digit down
    j, t = F.col("turn") - filled, F.col("n") - filled
    digit = F.floor(F.log2(j.bitwiseXOR(t).cast("double") + 0.5)).cast("int")
    low = F.expr("shiftright(j, digit)") * F.expr("shiftleft(1L, digit)")
    placed = (
        pieces.withColumn("worker", worker)
        .withColumns({"turn": turn, "n": F.count("*").over(group)})
        .withColumn("j", j)
        .withColumn("digit", digit)
        .withColumn("left_over", F.col("j") >= 0)
    )
    slot = F.when(F.col("left_over"), F.col("j") - low).otherwise(F.pmod("turn", per_bin))
    # worker, class and bin number make the id; a left-over bin is named by its first piece
    first = F.col("turn") - slot
    classes = capacity.bit_length()
    number = F.log2(size.cast("double")).cast("long")
    sequence = (first * classes + number) * workers_of(docs) + F.col("worker")
    return placed.select(
        F.col("id").alias(id_col),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        sequence.alias("sequence_id"),
        (slot * size).alias("offset"),
        *(["ids"] if with_ids else []),
    )
