import hashlib
import math
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from airstrata.llm import importance
from airstrata.llm.common import documents
from airstrata.session import table
from tests.conftest import SF
from tests.llm.fixtures import edge_documents, empty_documents

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text, n):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, n=1, percent=10, least=20, buckets=10_000):
    s, t = [0] * buckets, [0] * buckets
    for texts, sums in ((docs, s), (target, t)):
        for _, text in texts:
            for f in runs(text, n)[1]:
                sums[zlib.crc32(f.encode()) % buckets] += 1
    gains = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for key, text in docs:
        words, features = runs(text, n)
        weight = sum(gains[zlib.crc32(f.encode()) % buckets] for f in features)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = [(*r, i + 1 if i < percent * len(order) // 100 else None) for i, r in enumerate(order)]
    return drawn + [(*r, None) for r in rows if r[1] < least]


def plain(rows):
    return sorted(rows, key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"bc", b"\xc3\xa9", b"9"]), max_size=30), st.integers(1, 4))
def test_a_trie_counts_the_crc_of_every_run(words, run):
    trie = importance.WordTrie(97)
    trie.add(words, run)
    want = [0] * 97
    for k in range(1, run + 1):
        for i in range(len(words) - k + 1):
            want[zlib.crc32(b" ".join(words[i : i + k])) % 97] += 1
    assert trie.totals().tolist() == want


@given(st.text(max_size=60))
def test_words_are_those_of_the_pattern(text):
    assert importance.word_bytes(text) == [w.encode() for w in runs(text, 1)[0]]


@pytest.mark.parametrize("make,run,nodes", [(lambda s: documents(s, SF), 1, None), (lambda s: documents(s, SF), 3, 50), (edge_documents, 1, None), (edge_documents, 2, 1), (empty_documents, 1, None)])
def test_weights_and_ranks_are_those_of_brute_force(spark, monkeypatch, make, run, nodes):
    if nodes:
        monkeypatch.setattr(importance, "MOST_NODES", nodes)
    docs, target = make(spark), table(spark, SF, "benchmark")
    got = importance.resampled(docs, target, percent=30, least_words=5, run=run).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(0, r.text) for r in target.collect()], run, 30, 5)
    assert plain(map(tuple, got)) == plain(want)


def test_without_a_target_weights_follow_the_corpus_alone(spark):
    docs = spark.createDataFrame([(1, "a a b", "x"), (1, "a a b", "y"), (2, None, "z")], "doc_id long, text string, bucket string")
    got = importance.resampled(docs, empty_documents(spark), percent=100, least_words=1).collect()
    assert plain(map(tuple, got)) == plain(brute([(1, "a a b"), (1, "a a b"), (2, None)], [], 1, 100, 1))
