import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from airstrata.llm import line_rules, merkle, queries, segmentations, sentence_spans, sharding, site_lines
from airstrata.llm.common import documents, stage_path
from tests.conftest import SF
from tests.llm.fixtures import DOCS, edge_documents, empty_documents
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, SF, queries.queries()[name], queries.oracle_sql()[name]) is None


LINES = "\n".join(f"line {c} of some words that many pages hold" for c in "abcdefghij")


def hosts(spark):
    """Twelve pages of one host with a shared head, three copies of another page; two hosts."""
    name = lambda i: chr(97 + i // 26) + chr(97 + i % 26)  # noqa: E731  no digits: they are equal in normal lines
    own = lambda i: " ".join(f"w{name(i)}x{name(j)}" for j in range(80))
    rows = [(i, f"{LINES}\n{own(i)}", "en", "a", 0, i) for i in range(12)] + [(20 + i, f"copy\n{own(99)}", "en", "a", 0, i) for i in range(12)]
    rows += [(40 + i, f"{LINES}\n{own(40 + i)}", "en", "b", 0, i) for i in range(5)]
    return spark.createDataFrame(rows, DOCS)


def test_frequent_lines_go_from_all_but_the_first(spark):
    docs = hosts(spark)
    got = {r.doc_id: r for r in line_rules.verdicts(docs).collect()}
    words = len(LINES.split())
    assert [got[i].n_frequent_line_words for i in range(12)] == [0] + [words] * 11
    # Copies count as documents: one of them stays whole, the others are depleted.
    assert [got[20 + i].kept for i in range(12)] == [True] + [False] * 11
    assert all(got[40 + i].n_frequent_line_words == 0 for i in range(5))
    texts = {r.doc_id: r.text for r in line_rules.clean(docs).collect()}
    assert texts[0].startswith(LINES) and not any("of some words" in texts[i] for i in range(1, 12))
    assert set(texts) == {*range(12), 20, *range(40, 45)}


def test_boilerplate_goes_from_copies_of_the_first_holder(spark):
    rows = [(i, f"Read more\nown text {chr(97 + i // 3)}\nend", "en", f"s{i % 12}", 0, i) for i in range(24)]
    got = {r.doc_id: r for r in site_lines.deduped(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0].text == "Read more\nown text a\nend" and got[0].n_removed_lines == 0
    assert all(got[i].text == f"own text {chr(97 + i // 3)}" and got[i].n_removed_lines == 2 for i in range(1, 24))


def test_runs_need_words(spark):
    long = "Here stand several plain words in one row. And there stand some more of them again, all told."
    texts = [f"Yes. No. Maybe. {long} First.", f"Yes. No. Maybe. Other. {long} Second.", "Yes. No. Maybe."]
    got = [r.text for r in sentence_spans.deduped(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [texts[0], "Yes. No. Maybe. Other. Second.", texts[2]]


@pytest.mark.parametrize("make", [line_rules.clean, site_lines.deduped, sentence_spans.deduped])
def test_edge_documents_and_clashing_columns(spark, make):
    taken = "n_removed_lines n_sentences n_removed _row _doc _t _k _h _p _at _lost lost_places lost_lines _i _line _text"
    plain = edge_documents(spark)
    docs = plain.selectExpr("*", *[f"text_len AS {c}" for c in taken.split()])
    out = make(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert all(r[c] == r.text_len for r in rows for c in taken.split())
    if make is line_rules.clean:
        assert not rows  # too short, or repeated windows throughout
        kept = hosts(spark).selectExpr("*", *[f"doc_id AS {c}" for c in taken.split()])
        rows = make(kept).collect()
        assert len(rows) == 18 and all(r[c] == r.doc_id for r in rows for c in taken.split())
    else:
        assert len(rows) == 11 and len(out.columns) > len(docs.columns)
        assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, (r.doc_id for r in docs.collect())))
    assert make(empty_documents(spark)).count() == 0


def test_verdicts_of_edge_documents(spark):
    got = line_rules.verdicts(edge_documents(spark)).collect()
    assert len(got) == 11 and all(r.base_failed for r in got)
    assert sorted(r.n_words for r in got) == [0, 0, 0, 0, 3, 4, 6, 6, 6, 60_000, 60_000]
    assert line_rules.verdicts(empty_documents(spark)).count() == 0


def test_merkle_equals_brute_force_and_locates_edits(spark):
    docs = documents(spark, SF)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    prints = {}
    for r in merkle.op7_merkle(spark, SF).collect():
        t = texts[r.doc_id]
        q = len(t) // 4
        edited = t[: len(t) - q] + texts[after[r.doc_id]][:q]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        prints.setdefault(t, set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len(set.union(*prints.values())) == len(prints)
    two = spark.createDataFrame([("one\ntwo\nthree", "one\n2\nthree")], "a string, b string")
    got = two.select(merkle.edits(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("e")).first()
    assert got.e == [1]
    assert merkle.with_next(edge_documents(spark)).count() == 11
    assert merkle.with_next(empty_documents(spark)).count() == 0


def alike(a, b):
    """Likeness of two fingerprints, by sets."""
    if a.split("|")[0] == b.split("|")[0]:
        return 1.0
    both, same = [set(x.split("|")[1].split("/")) for x in (a, b)], 0
    size = lambda nodes, head: sum(len(p.split("=")[1]) // 8 for s in nodes for p in s[head:].split(","))
    same += size(both[0] & both[1], 9)
    parts = [{p for s in x - y for p in s[9:].split(",")} for x, y in (both, both[::-1])]
    same += size(parts[0] & parts[1], 0)
    runs = [{p[17 + i : 25 + i] for p in x - y for i in range(0, len(p) - 17, 8)} for x, y in (parts, parts[::-1])]
    total = 2 * same + len(runs[0]) + len(runs[1])
    return 2 * (same + len(runs[0] & runs[1])) / total if total else 1.0


def test_likeness_equals_brute_force(spark):
    rows = merkle.op7_merkle(spark, SF).orderBy("doc_id").collect()
    after = [r.fingerprint for r in rows[1:] + rows[:1]]
    for r, n in zip(rows, after):
        assert abs(r.near_edited - alike(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert abs(r.near_next - alike(r.fingerprint, n)) < 1e-12
    assert np.median([r.near_edited for r in rows]) > 0.6 and np.median([r.near_next for r in rows]) < 0.2


def test_likeness_holds_for_long_texts(spark):
    r = np.random.default_rng(9)
    texts = ["\n".join(" ".join(f"{x:x}" for x in r.integers(0, 1 << 40, 24).tolist()) for _ in range(12_000)) for _ in range(2)]
    rows = merkle.with_next(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = rows.select(merkle.fingerprint(F.col("text")).alias("own"), merkle.fingerprint(F.col("edited")).alias("other"), "next_fingerprint")
    got = merkle.with_likeness(merkle.with_likeness(rows, "own", "next_fingerprint", "next"), "own", "other", "edited").collect()
    assert len(got) == 2 and all(len(t) > 2_500_000 for t in texts)
    assert all(x.next < 0.001 and abs(x.edited - 0.75) < 0.01 for x in got)


def test_shards_are_near_equal_and_gapless(spark):
    rows, texts = sharding.op8_virtual_slots(spark, SF).collect(), {r.doc_id: (r.text or "").encode() for r in documents(spark, SF).collect()}
    load, places, maps = [0] * 40, {}, {}
    for r in rows:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]))
        load[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
        maps.setdefault(r.virtual_slot, set()).add((r.shard, r.next_shard))
    assert len(rows) == len(texts) and all(sorted(p) == list(range(len(p))) for p in places.values())
    # No slot is larger than a shard may be off by.
    assert max(load) - min(load) <= max(r.size for r in rows)
    assert all(len(m) == 1 for m in maps.values())


def test_a_map_is_edited_by_few_moves(spark):
    r = np.random.default_rng(4)
    slots = [sharding.Slot(i, 5, int(n)) for i, n in enumerate(r.integers(900, 1100, sharding.N_SLOTS))]
    total, first = sum(s.n_bytes for s in slots), sharding.first_map(slots, 40)
    grown = sharding.rebalanced(first, slots, 41)
    moved = [s for s in slots if first[s.slot] != grown[s.slot]]
    assert all(grown[s.slot] == 40 for s in moved) and sum(s.n_bytes for s in moved) <= total / 41 * 1.05
    for held, n in ((first, 40), (grown, 41), (sharding.rebalanced(grown, slots, 39), 39)):
        load = [0] * n
        for s in slots:
            load[held[s.slot]] += s.n_bytes
        assert max(load) <= total / n * 1.03 and set(held.values()) == set(range(n))


def test_shards_of_edge_documents(spark):
    for docs, n in ((edge_documents(spark), 11), (empty_documents(spark), 0)):
        recs = sharding.records(docs.withColumn("shard", F.col("doc_id")).withColumn("slot", F.col("doc_id")))
        slots, path = sharding.slot_sizes(recs), stage_path(spark, "test-map")
        sharding.store_map(spark, path, 1, sharding.first_map(slots, 3), slots)
        rows = sharding.assign(recs, sharding.read_map(spark, path)).collect()
        assert len(rows) == n and len({(r.shard, r.slot) for r in rows}) == n
        assert sorted(r.size for r in rows) == sorted(len((r.text or "").encode()) + 16 for r in docs.collect())


def test_samples_decode_to_the_text_and_are_the_same_again(spark):
    docs = documents(spark, SF).limit(60).union(edge_documents(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    rows = segmentations.decoded(segmentations.sampled(docs)).collect()
    texts = {(r.doc_id, r.text or "") for r in docs.collect()}
    assert {(r.doc_id, r.text) for r in rows} == texts
    again = segmentations.sampled(docs.repartition(3)).collect()
    assert sorted((str(r.doc_id), r["rank"], r.ids) for r in rows) == sorted((str(r.doc_id), r["rank"], r.ids) for r in again)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(segmentations.VOCABULARY))
    for r in rows[:40]:
        assert sp.decode(np.frombuffer(r.ids, "<u2").tolist()) == r.text
    assert segmentations.sampled(empty_documents(spark)).count() == 0


def every_path(lattices, unit):
    """All paths of a unit as tuples of edges, with their log-probabilities."""
    base, end = int(lattices.bases[unit]), None
    out, todo = [], [((), 0, 0.0)]
    while todo:
        edges, place, log_prob = todo.pop()
        lo, hi = lattices.first[base + place], lattices.first[base + place + 1]
        if lo == hi:
            out.append((edges, log_prob))
        for e in range(lo, hi):
            todo.append(((*edges, e), place + int(lattices.length[e]), log_prob + float(lattices.logq[e])))
    return out


def test_samples_of_a_small_lattice_follow_the_law_of_gumbel_top_k():
    """Against all paths of a lattice: of k perturbed paths the first is drawn by its probability, the next one by its
    probability among the rest, and the inclusion scores are those of the paths' own probabilities at the threshold."""
    vocabulary = segmentations.Vocabulary(public_tokenizers.path(segmentations.VOCABULARY))
    n = 20_000
    found = segmentations.Search(vocabulary, ["cat"] * n, [int(x) for x in np.random.default_rng(6).integers(0, 2**63, n)], 2)
    paths = dict(every_path(found.lattices, int(found.unit[0])))
    prob = {e: math.exp(p) for e, p in paths.items()}
    assert len(paths) > 3 and abs(sum(prob.values()) - 1) < 1e-9
    pairs, perturbed = {}, []
    for (a, b), threshold in found.paths():
        key = tuple(a[0].tolist()), tuple(b[0].tolist())
        assert key[0] != key[1] and a[2] >= b[2] >= threshold
        assert abs(a[1] - paths[key[0]]) < 1e-9 and abs(b[1] - paths[key[1]]) < 1e-9
        pairs[key] = pairs.get(key, 0) + 1
        perturbed.append(a[2])
    for x, p in prob.items():
        for y, q in prob.items():
            want = p * q / (1 - p)
            assert x == y or abs(pairs.get((x, y), 0) / n - want) < 5 * math.sqrt(want / n) + 1 / n
    # The best of all is standard Gumbel: mean 0.5772, spread pi / sqrt(6).
    assert abs(np.mean(perturbed) - 0.5772) < 0.05 and abs(np.std(perturbed) - math.pi / math.sqrt(6)) < 0.05


def test_decoded_texts_find_a_free_name(spark):
    docs = edge_documents(spark)
    rows = segmentations.decoded(segmentations.sampled(docs).withColumn("text", F.lit("own")))
    assert rows.columns[-1] == "text_" and {r.text for r in rows.collect()} == {"own"}


def samples_of(vocabulary, texts, k=2):
    """Ids, log-probability and perturbed value of each path, and the thresholds."""
    search = segmentations.Search(vocabulary, texts, list(range(1, len(texts) + 1)), k)
    return [([(vocabulary.spelled(search.lattices.code[e])[0].tolist(), p, v) for e, p, v in paths], t) for paths, t in search.paths()]


def test_lattices_are_built_once_for_units_that_come_again(spark, monkeypatch):
    """op2 of the third round: lattices were built anew for each slice. Kept ones, a bound of them, and hashes that
    units share give the rows that lattices of their own give."""
    texts = [r.text or "" for r in documents(spark, SF).limit(40).collect()] + ["", " ", "\n", " \n  a\n", "x" * 300, "ab\u2581\u2581c \U0001f642", "the cat  the cat "]
    path = public_tokenizers.path(segmentations.VOCABULARY)
    vocabulary = segmentations.Vocabulary(path)
    want = samples_of(vocabulary, texts)
    n_edges = vocabulary.lattices.n_edges
    assert samples_of(vocabulary, texts) == want and vocabulary.lattices.n_edges == n_edges > 0
    singly = [samples_of(segmentations.Vocabulary(path), [""] * i + [t])[-1] for i, t in enumerate(texts) if i > 38]
    for (a, t), (b, u) in zip(singly, want[39:]):
        assert [x[0] for x in a] == [x[0] for x in b] and t == pytest.approx(u) and [x[1:] for x in a] == [pytest.approx(x[1:]) for x in b]
    for _ in range(3):
        samples_of(vocabulary, texts[40:])
    monkeypatch.setattr(segmentations, "_EDGES", n_edges // 2)
    vocabulary.lattices = vocabulary.lattices.kept()
    assert 0 < vocabulary.lattices.n_edges <= n_edges // 4
    assert samples_of(vocabulary, texts) == want
    hashed = segmentations.Lattices.hashed
    monkeypatch.setattr(segmentations.Lattices, "hashed", lambda self, *x: hashed(self, *x) % np.uint64(2**64 - 1 if self.seed else 16))
    vocabulary.lattices = segmentations.Lattices(vocabulary)
    assert samples_of(vocabulary, texts) == want and vocabulary.lattices.seed == 1


def test_ids_that_are_no_text_decode_as_before():
    vocabulary = segmentations.Vocabulary(public_tokenizers.path(segmentations.VOCABULARY))
    raw, rng = vocabulary.raw, np.random.default_rng(3)
    lists = [None, b"", *(rng.integers(0, len(raw), n).astype("<u2").tobytes() for n in (0, 1, 5, 9, 40)), np.array([vocabulary.bytes[0xC3]], "<u2").tobytes()]
    want = [x if x is None else b"".join(raw[i] for i in np.frombuffer(x, "<u2").tolist()).decode(errors="replace").removeprefix(" ") for x in lists]
    ids = pa.array(lists, pa.binary())
    for a, b in ((0, 8), (0, 2), (3, 6), (1, 1)):
        assert segmentations.texts_of(pa.array(raw, pa.binary()), ids[a:b]).to_pylist() == want[a:b]


def test_inclusion_scores_estimate_sums_without_bias():
    vocabulary = segmentations.Vocabulary(public_tokenizers.path(segmentations.VOCABULARY))
    n, total = 3000, 0.0
    found = segmentations.Search(vocabulary, ["the cat"] * n, [int(x) for x in np.random.default_rng(5).integers(0, 2**63, n)], 3).paths()
    for paths, threshold in found:
        assert [v for _, _, v in paths] == sorted((v for _, _, v in paths), reverse=True)
        assert len({tuple(e.tolist()) for e, _, _ in paths}) == 3
        total += sum(math.exp(p) / -math.expm1(-math.exp(p - threshold)) for _, p, _ in paths) / n
    assert abs(total - 1) < 0.01
