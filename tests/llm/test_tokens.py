import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from airstrata.llm.packing import hilbert_key, project, signs
from airstrata.llm.token_store import EliasFano, ef_encode
from airstrata.llm.tokens import Encoder, vocabulary_path

ENC = Encoder(vocabulary_path())
ODD = [chr(c) for c in (0xA0, 0x2003, 0x3000, 0x1C)]
PARTS = st.sampled_from([*ODD, "word", "don't", "Été", "ß", "x1", "12", ".", ",", "!.", "...", " ", "  ", "\n", "\n\n", "\t ", "漢字", "<|endoftext|>", "_", "'s", "é.", "½,", "\r\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join) | st.text(max_size=40))
def test_chunks_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(ENC.encode([text])[0], "<u4").tolist() == ENC.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=900).map(sorted), st.integers(0, 10**7))
def test_elias_fano_returns_every_value(values, more):
    ef = EliasFano(ef_encode(np.array(values, dtype=np.int64), (values[-1] if values else 0) + more))
    assert ef.all().tolist() == values
    assert [ef.select(k) for k in range(0, len(values), 37)] == values[::37]


def test_elias_fano_is_small():
    ends = np.cumsum(np.full(10_000, 700))
    assert len(ef_encode(ends, int(ends[-1]))) * 8 < 13 * 10_000


def test_hilbert_key_walks_to_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_key(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_projection_of_equal_and_empty_texts():
    t = signs()
    assert (project(b"some text", t) == project(b"some text", t)).all()
    assert project(b"", t).shape == (3,)
