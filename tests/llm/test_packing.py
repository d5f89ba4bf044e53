import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from odd_rows import TEXTS, no_documents, odd_documents
from tokenizers import Tokenizer

from lumenbar.llm.packing import cuts, pack


def ids_by_tokenizers(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def checked(pieces, docs, repeated=()):
    for p in pieces:
        assert p.length == len(p.ids) > 0
        assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *p.ids))
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for doc, text in docs:
        ids = ids_by_tokenizers(text)
        found = sorted(by_doc[doc], key=lambda p: p.start)
        if doc in repeated:
            found = found[::2]
        assert [i for p in found for i in p.ids] == ids
        assert all(p.doc_tokens == len(ids) for p in found)
    bins = defaultdict(list)
    for p in pieces:
        bins[p.sequence_id].append((p.offset, p.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        # full, or a power of two: nothing is padded
        assert end <= 1024 and end & (end - 1) == 0
    return bins


def test_odd_rows_round_trip(spark):
    pieces = pack(odd_documents(spark), with_ids=True).collect()
    checked(pieces, {(i, t) for i, t, _ in TEXTS}, repeated={1})


def test_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = pack(docs, with_ids=True).collect()
    bins = checked(pieces, [(r.doc_id, r.text) for r in docs.collect()])
    filled = Counter(sum(n for _, n in parts) == 1024 for parts in bins.values())
    assert filled[True] > filled[False]
    narrow = pack(docs).collect()
    assert Counter(r[:7] for r in narrow) == Counter(r[:7] for r in pack(docs.repartition(4)).collect())


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 5000])
def test_cuts(n):
    out = cuts(n)
    assert sum(out) == n and all(x & (x - 1) == 0 and x <= 1024 for x in out)
    assert len(set(out[n // 1024 :])) == len(out[n // 1024 :])


def test_empty_table_and_capacity(spark):
    assert pack(no_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        pack(no_documents(spark), capacity=1000)
