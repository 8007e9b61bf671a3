import hashlib
import random

import numpy as np
import pytest

from airstrata.llm import repeats
from tests.llm.fixtures import DOCS, edge_documents, empty_documents


def brute(texts, length):
    """Mask of each text: bytes in a string of `length` bytes that starts anywhere else too."""
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append(mask)
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcd ") for _ in range(r.randint(30, 90))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [r.choice(passages)[r.randint(0, 9) :] if r.random() < 0.5 else "".join(r.choice("abcdefgh é") for _ in range(r.randint(0, 60))) for _ in range(r.randint(0, 5))]
        texts.append("".join(parts))
    return texts + texts[:5] + ["x" * 100, "xy" * 70, ""]


@pytest.mark.parametrize("most", [4096, 3])
def test_spans_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST", most)
    texts = corpus(most)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.key: [(s.a, s.b) for s in r.spans] for r in repeats.repeated_spans(docs, length=40, chunk=24).collect()}
    for i, (t, mask) in enumerate(zip(texts, brute([t.encode() for t in texts], 40))):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(int)))
        assert got.get(i, []) == list(zip(edges[::2].tolist(), edges[1::2].tolist())), i


def brute_later(texts, length):
    """The same for windows that are held earlier: in an earlier text, or before in the same one."""
    seen, out = set(), []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if t[i : i + length] in seen:
                mask[i : i + length] = True
            seen.add(t[i : i + length])
        out.append(mask)
    return out


@pytest.mark.parametrize("most", [4096, 3])
def test_first_holders_keep_their_passages(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST", most)
    texts = corpus(most + 1)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.key: [(s.a, s.b) for s in r.spans] for r in repeats.repeated_spans(docs, length=40, chunk=24, keep_first=True).collect()}
    for i, (t, mask) in enumerate(zip(texts, brute_later([t.encode() for t in texts], 40))):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(int)))
        assert got.get(i, []) == list(zip(edges[::2].tolist(), edges[1::2].tolist())), i


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    some = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passages = [some(n) for n in (260, 300, 390, 400, 401, 700)]
    texts = [some(r.randint(0, 300)) + "".join(r.choice(passages) + some(r.randint(0, 40)) for _ in range(r.randint(0, 3))) for _ in range(40)]
    texts += [None, "", texts[3], passages[5] * 2] + edited_copies(3, 2, 4)
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in repeats.op4_run_length_index(spark, str(tmp_path)).collect()}
    data = [(t or "").encode() for t in texts]
    for i, (t, long, short) in enumerate(zip(data, brute(data, 400), brute(data, repeats.PASSAGE))):
        left = hashlib.sha256(bytes(c for c, gone in zip(t, long) if not gone)).hexdigest()
        spans = int((np.diff(np.concatenate([[0], long.astype(int)])) == 1).sum())
        assert tuple(got[i]) == (i, len(t), int(long.sum()), spans, left, int(short.sum())), i
    assert sum(x.n_removed > 0 for x in got.values()) > 10 and sum(x.n_passage_bytes > x.n_removed for x in got.values()) > 10


def test_columns_with_the_operators_own_names_are_kept(spark):
    names = "spans _spans _cut _row key h place core first"
    docs = edge_documents(spark).selectExpr("*", *[f"doc_id AS {c}" for c in names.split()])
    out = repeats.deduped(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.drop("text").collect())) == sorted(map(str, docs.drop("text").collect()))


def test_edge_documents(spark):
    docs = edge_documents(spark)
    out = {(r.doc_id, r.text_len): r for r in repeats.deduped(docs).collect()}
    assert out[(8, 7)].text == out[(9, 8)].text == ""
    assert out[(1, 4)].text is None and out[(10, 9)].text == "été 漢字 🙂 x"
    assert repeats.deduped(docs).columns == docs.columns
    first = {(r.doc_id, r.text_len): r.text for r in repeats.deduped(docs, keep_first=True).collect()}
    # Repeated within the text from place 0 on, and in the second copy altogether.
    assert 0 < len(first[(8, 7)]) < len(docs.where("text_len = 7").first().text) and first[(9, 8)] == ""
    assert repeats.deduped(empty_documents(spark)).count() == 0


def test_characters_stay_whole():
    data = "aé漢b".encode()
    for a in range(len(data)):
        for b in range(a, len(data) + 1):
            repeats.without(data, repeats.whole_characters(data, [(a, b)])).decode()
    assert hashlib.sha256(repeats.without(b"abcdef", [(1, 3), (5, 6)])).digest() == hashlib.sha256(b"ade").digest()


def edited_copies(seed, groups=5, copies=6):
    """Groups of near copies that begin alike and are edited at different places."""
    r = random.Random(seed)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    texts = []
    for _ in range(groups):
        base = some(r.randint(900, 1500))
        for _ in range(copies):
            own = list(base)
            for _ in range(r.randint(1, 2)):
                own[r.randrange(300, len(own))] = r.choice("XYZ")
            texts.append("".join(own))
    return texts


def test_edited_copies_equal_brute_force_at_the_production_sizes(spark):
    texts = edited_copies(7)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.key: [(s.a, s.b) for s in r.spans] for r in repeats.repeated_spans(docs, length=400, chunk=256).collect()}
    for i, (t, mask) in enumerate(zip(texts, brute([t.encode() for t in texts], 400))):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(int)))
        assert got.get(i, []) == list(zip(edges[::2].tolist(), edges[1::2].tolist())), i


def test_index_has_the_longest_match_of_every_place():
    r = np.random.default_rng(5)
    for chunk in (8, 16):
        shared, parts = r.integers(0, 3, 2 * chunk - 1), []
        for i, n in enumerate(r.integers(chunk - 1, 2 * chunk, 40).tolist()):
            parts += [shared[:n], [256 + i]]
        s = np.concatenate(parts).astype(np.uint16)
        places = [s[i:].tobytes() for i in range(len(s))]
        common = lambda a, b: next((k for k in range(0, min(len(a), len(b)), 2) if a[k : k + 2] != b[k : k + 2]), min(len(a), len(b))) // 2
        want = [max(common(a, b) for j, b in enumerate(places) if j != i) for i, a in enumerate(places)]
        assert repeats.RunLengthIndex(s).matching_statistics().tolist() == want
