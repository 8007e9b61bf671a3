import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from airstrata.llm import best_fit
from airstrata.llm.common import documents
from airstrata.llm.tokens import Encoder, vocabulary_path
from tests.conftest import SF
from tests.llm.fixtures import edge_documents, empty_documents

ENC = Encoder(vocabulary_path())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_is_that_of_a_plain_search(sizes):
    names = np.arange(100, 100 + len(sizes))
    owner, place = best_fit.best_fit(np.array(sizes, np.int64), names, 30)
    bins = {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        holds = [b for b, items in bins.items() if 30 - sum(items) >= sizes[i]]
        room = min((30 - sum(bins[b]) for b in holds), default=None)
        mine = int(owner[i])
        assert mine in bins and 30 - sum(bins[mine]) == room if holds else mine == names[i]
        assert place[i] == sum(bins.get(mine, []))
        bins.setdefault(mine, []).append(sizes[i])


@pytest.mark.parametrize("make,length,group", [(lambda s: documents(s, SF), 1024, 20_000), (lambda s: documents(s, SF), 1024, 16), (lambda s: documents(s, SF), 100, 300), (edge_documents, 1024, 3), (empty_documents, 1024, 10)])
def test_packing_holds_each_id_once(spark, make, length, group):
    docs = make(spark)
    got = best_fit.pack(docs, length=length, group=group, with_ids=True).collect()
    by, whole = {}, {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    want = [(r.doc_id, np.array([*ENC.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in docs.collect()]
    cuts = []
    for key, ids in want:
        first = len(ids) // 4 % length or length
        ends = [0, *range(first, len(ids) // 4, length), len(ids) // 4]
        cuts += [(key, k, a, ids[4 * a : 4 * b]) for k, (a, b) in enumerate(zip(ends, ends[1:]))]
    assert sorted(map(str, cuts)) == sorted(str((r.doc_id, r.piece, r.start, bytes(r.ids))) for r in got)
    if cuts:
        sizes = np.array([len(c[3]) // 4 for c in cuts])
        alone = len(set(best_fit.best_fit(sizes, np.arange(len(sizes)), length)[0].tolist()))
        assert len(by) <= alone + max(1, len(sizes) // group) * (group < 100)


def test_underfull_sequences_of_groups_meet(spark):
    """Groups of few items leave halves that only later rounds join."""
    items = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "0L as start", "case when id % 3 = 0 then 11L else 7L end as length", "0L as ids_crc32", "id as item", "id as sequence_id", "0L as offset")
    got = best_fit.packed(items, room=18, group=5, slack=0).collect()
    filled = {}
    for r in got:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert len(got) == 3000 and max(filled.values()) <= 18
    assert len(filled) < 1.04 * 1500
