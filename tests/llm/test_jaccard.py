import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from airstrata import session
from airstrata.llm import jaccard
from airstrata.llm.components import components
from tests.llm.fixtures import edge_documents, empty_documents


def brute(texts):
    sets, parent = {}, {d: d for d in texts}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    def root(x):
        return x if parent[x] == x else root(parent[x])

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed):
    """Chains of edited copies near the threshold, exact copies, a passage that many texts share."""
    r, out = random.Random(seed), {}
    passage = [f"p{i}" for i in range(40)]
    for _ in range(8):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.randint(6, 160))]
        for _ in range(r.randint(1, 14)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 40))):
                own[r.randrange(len(own))] = f"e{r.randint(0, 999)}"
            if r.random() < 0.4:
                base = own
            out[len(out)] = " ".join(own + passage * (r.random() < 0.5))
    out |= {len(out): "A b", len(out) + 1: "a B", len(out) + 2: None, len(out) + 3: "", len(out) + 4: " \n"}
    return out


@pytest.mark.parametrize(("block", "groups"), [(2048, 1024), (4, 16)])
def test_components_equal_brute_force(spark, monkeypatch, block, groups):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "TREE_GROUPS", groups)
    texts = corpus(block)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.key: (r.n_shingles, r.component_id) for r in jaccard.joined(docs).collect()}
    assert got == brute(texts)


def test_five_words_hash_as_shingles_of_longer_texts(spark):
    texts = {0: "a a a a a", 1: "A a a a a a", 2: " ".join("a" * 9), 3: "a a a a", 4: "b b b b b", 5: "c d e f g", 6: "c d e f g h"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.key: (r.n_shingles, r.component_id) for r in jaccard.joined(docs).collect()} == brute(texts)


def test_edge_documents(spark):
    rows = jaccard.joined(edge_documents(spark)).collect()
    assert len(rows) == 11 and sorted(r.component_id for r in rows if r.key in (8, 9)) == [8, 8]
    assert jaccard.joined(empty_documents(spark)).count() == 0


def test_one_of_each_component_stays(spark):
    docs = edge_documents(spark).selectExpr("*", "doc_id AS first", "doc_id AS _id", "doc_id AS h", "doc_id AS _again")
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text_len) for r in out.collect()), key=str)
    # One of the two equal rows, the other text of id 3, one of two equal texts, and all without words.
    assert got == sorted([(3, 1), (3, 2), (None, 3), (None, None), (1, 4), (2, 5), (7, 6), (8, 7), (10, 9)], key=str)
    assert jaccard.one_of_each(empty_documents(spark)).count() == 0


def test_staged_tables_are_deleted_but_for_what_the_result_reads(spark):
    folder = Path(session.shared_dir(spark).removeprefix("file:")) / "airstrata"
    before = set(folder.iterdir()) if folder.exists() else set()
    docs = spark.createDataFrame(list(corpus(1).items()), "doc_id long, text string")
    assert jaccard.joined(docs).count() == docs.count()
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert not left & {"cells", "classes", "texts", "found", "candidates", "second", "open-several", "least"} and {"signatures", "checked", "more"} <= left


def test_tree_finds_all_that_the_bound_lets_through():
    r = np.random.default_rng(3)
    points = r.poisson(4, (700, 16)).astype(np.uint16)
    points[100:200] = np.maximum(points[100].astype(int) + r.integers(-1, 2, (100, 16)), 0)
    sizes = points.sum(axis=1).astype(np.int64)
    tree = jaccard.Tree(points, sizes)
    for i in range(0, 700, 50):
        bound = np.minimum(points, points[i]).sum(axis=1)
        want = np.flatnonzero((bound * 180 >= 80 * (sizes + sizes[i])) & (100 * np.minimum(sizes, sizes[i]) >= 80 * np.maximum(sizes, sizes[i])))
        assert set(want) <= set(tree.search(points[i], int(sizes[i]), 80).tolist())


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 120)] + [(200, 200)]
    parts = defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        parts[r.label].add(r.node)
    assert parts == {0: set(range(31)), 100: set(range(100, 120))}
