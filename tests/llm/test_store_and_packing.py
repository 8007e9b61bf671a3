import zlib

import numpy as np
import pytest

from airstrata.llm import packing, token_store
from airstrata.llm.common import documents, stage_path
from airstrata.llm.tokens import Encoder, vocabulary_path
from tests.conftest import SF
from tests.llm.fixtures import edge_documents, empty_documents

ENC = Encoder(vocabulary_path())


def ids_of(text):
    return np.array([*ENC.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.mark.parametrize("make", [lambda s: documents(s, SF), edge_documents, empty_documents])
def test_store_gives_back_every_document(spark, make):
    docs, path = make(spark), stage_path(spark, "test-store")
    token_store.write_store(docs, path, block_ids=3000)
    got = token_store.read_store(spark, path).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [r.doc_id for r in rows]
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    want = sorted((r.doc_id or -1, len(ids_of(r.text)), zlib.crc32(ids_of(r.text))) for r in rows)
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == want


def test_lookup_selects_one_document(spark):
    docs, path = documents(spark, SF), stage_path(spark, "test-lookup")
    token_store.write_store(docs, path, block_ids=5000)
    text = {r.doc_id: r.text for r in docs.collect()}
    row = spark.read.schema(token_store.BLOCK_SCHEMA).parquet(path).orderBy("part", "block").first()
    for k, key in enumerate(token_store.block_keys(row["keys"])[0]):
        assert token_store.lookup(spark, path, row.part, row.block, k).tolist() == ids_of(text[key]).tolist()
        if k == 3:
            break


@pytest.mark.parametrize("make", [lambda s: documents(s, SF), edge_documents, empty_documents])
def test_packing_holds_each_id_once(spark, make):
    docs = make(spark)
    got = packing.pack(docs, with_ids=True).collect()
    if not docs.count():
        assert not got
        return
    total = sum(len(ids_of(r.text)) for r in docs.collect())
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for s, pieces in by.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or s == max(by)
    assert sorted(by) == list(range(-(-total // 1024)))
    want = sorted((r.doc_id or -1, ids_of(r.text).tobytes()) for r in docs.collect())
    whole = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            whole.setdefault((r.doc_id or -1), []).append(b"")
        whole[(r.doc_id or -1)][-1] += r.ids
    assert sorted((k, x) for k, v in whole.items() for x in v) == want


def test_neighbours_on_the_curve_share_a_language(spark):
    docs = documents(spark, SF)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    order = [r.doc_id for r in sorted(packing.pack(docs).collect(), key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    same = sum(lang[a] == lang[b] for a, b in zip(order, order[1:])) / (len(order) - 1)
    assert same > 0.5
