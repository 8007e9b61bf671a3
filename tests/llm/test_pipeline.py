import re

import pytest

import corpus_pipeline
from airstrata.llm import line_rules, repeats, site_lines
from airstrata.llm.common import documents
from tests.conftest import SF
from tests.llm.fixtures import edge_documents, empty_documents
from tests.llm.test_jaccard import brute as components
from tests.llm.test_repeats import brute_later
from tests.llm.test_store_and_packing import ids_of

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_keep_the_columns_and_run_on_edges(spark):
    for docs in (edge_documents(spark), empty_documents(spark)):
        docs = docs.selectExpr("*", *[f"text_len AS {c}" for c in ("n_removed_lines", "first", "spans", "h", "sequence_id")])
        for _, make in corpus_pipeline.STAGES[:-1]:
            out = make(spark, docs, SF)
            assert out.columns == docs.columns
            assert all(r.n_removed_lines == r.text_len == r.h for r in out.collect())
        assert "sequence_id" in corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns


def split(text):
    return [re.sub("[0-9]+", "0", " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x)))) for x in text.split("\n")]


def frequent(docs, by, limit):
    """The lines with `limit` or more of what `by` gives, with the first document that has each."""
    held = {}
    for d, t in sorted(docs.items()):
        for x in split(t):
            held.setdefault(x, {}).setdefault(by(d), d)
    return {x: min(own.values()) for x, own in held.items() if x and len(own) >= limit}


def without(text, gone):
    return "\n".join(raw for raw, x in zip(text.split("\n"), split(text)) if x not in gone)


def quality(docs, host):
    out = {}
    for h in set(host.values()):
        own = {d: t for d, t in docs.items() if host[d] == h}
        often = frequent(own, lambda d: d, line_rules.MAX_DOCS + 1)
        for d, t in own.items():
            words = re.findall(r"[^\x20\x09-\x0D]+", t)
            grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
            covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 3)}
            new = without(t, {x for x, first in often.items() if first != d})
            left = len(re.findall(r"[^\x20\x09-\x0D]+", new))
            if len(words) >= 50 and 100 * len(covered) <= 50 * len(words) and left >= line_rules.MIN_LEFT and left >= line_rules.MIN_LEFT_SHARE * len(words):
                out[d] = new
    return out


def spread(docs, host):
    wide, out = frequent(docs, host.__getitem__, site_lines.MIN_SITES), {}
    for d, t in docs.items():
        # `frequent` has the first of each host; the first of all is the least of them.
        new = without(t, {x for x, first in wide.items() if first != d})
        if new == t or new.split():
            out[d] = new
    return out


def near(docs, host):
    return {d: docs[d] for d, (n, c) in components(docs).items() if n == 0 or c == d}


def passages(docs, host):
    out = {}
    for d, mask in zip(sorted(docs), brute_later([docs[d].encode() for d in sorted(docs)], repeats.PASSAGE)):
        data = docs[d].encode()
        edges = [i for i in range(len(mask) + 1) if (i > 0 and mask[i - 1]) != (i < len(mask) and mask[i])]
        new = repeats.without(data, repeats.whole_characters(data, list(zip(edges[::2], edges[1::2])))).decode()
        if not edges or new.split():
            out[d] = new
    return out


def test_every_stage_equals_brute_force(spark):
    docs = documents(spark, SF)
    for name, brute in (("quality_rules", quality), ("line_dedup", spread), ("near_duplicates", near), ("repeated_passages", passages)):
        rows = docs.collect()
        want = brute({r.doc_id: r.text or "" for r in rows}, {r.doc_id: r.source for r in rows})
        docs = STAGES[name](spark, docs, SF).cache()
        assert {r.doc_id: r.text for r in docs.collect()} == want and 0 < len(want) < 200, name
        assert all(r.n_chars == len(r.text) for r in docs.collect()), name
    pieces = STAGES["packing"](spark, docs, SF).collect()
    want = {d: len(ids_of(t)) for d, t in ((r.doc_id, r.text) for r in docs.collect())}
    got = {}
    for r in pieces:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r.doc_id for r in rows}) < 200
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r.length)
    assert all(sum(v) == 1024 for s, v in by.items() if s != max(by))


@pytest.mark.parametrize("name", ["line_dedup", "repeated_passages"])
def test_used_up_documents_go(spark, name):
    head = " ".join(f"word{i}" for i in range(120))
    docs = spark.createDataFrame([(i, head, "en", f"s{i}", 0) for i in range(12)] + [(12, "", "en", "s", 0), (13, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in STAGES[name](spark, docs, SF).collect()) == [0, 12, 13]
