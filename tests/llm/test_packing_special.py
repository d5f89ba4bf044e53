"""Ids equal those of the tokenizers file with its added token, for any text."""

import struct
import zlib

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenbar.llm.catalog import op1_harmonic_packing
from lumenbar.llm.packing import encode_as_file, pack, public_vocabulary

TEXTS = [
    "a<|endoftext|>b",
    "<|endoftext|>",
    " <|endoftext|><|endoftext|> it's\n\n<|endoftext|>\n 12 <|endoftext|",
    "\n" * 1_000_000 + "a",
    "x" + "\t 　\x85" * 50_000 + "<|endoftext|>  y",
    "a" * 300_000 + " " * 9_999 + "b" + "." * 20_000,
]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_plain_encode(spark, reference):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    pieces = pack(docs, with_ids=True, added_tokens=True).collect()
    found = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        found.setdefault(p.doc_id, []).extend(p.ids)
    for i, text in enumerate(TEXTS):
        assert found[i] == reference.encode(text, add_special_tokens=False).ids + [0]


def test_query_and_stage_give_the_ids_of_the_file(spark, tmp_path):
    docs = spark.createDataFrame([(0, TEXTS[0], "s")], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = zlib.crc32(struct.pack("<4I", 64, 50256, 65, 0))
    for out in (op1_harmonic_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, "")):
        assert [(r.length, r.ids_crc32, r.doc_tokens) for r in out.collect()] == [(4, want, 4)]


def test_every_character_is_split_alike(reference):
    """Letters, numbers and white space are the same characters to both libraries."""
    encode = encode_as_file(*public_vocabulary())
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 20_000):
        texts = [
            f"a{c}a1{c}1.{c}. {c} a  {c}{c}  {c}" for c in map(chr, points[at : at + 20_000])
        ]
        for text, want in zip(texts, reference.encode_batch(texts, add_special_tokens=False)):
            assert encode(text) == want.ids
