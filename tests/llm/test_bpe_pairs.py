"""What is remembered of pairs of tokens is bounded, and forgetting it changes no ids."""

from quiremill.llm import bpe
from quiremill.llm._common import default_vocabulary


def test_forgotten_pairs_of_tokens_change_no_ids():
    one, text = bpe.WordBpe(default_vocabulary(), remember=2), "unforeseeable counterrevolutionaries überraschend zxqvkj"
    before = one.encode(text)
    assert 0 < one._n_fits == sum(map(len, one._fits.values()))
    one._n_fits = 500_000
    assert not any(one.encode_word(w) is None for w in ("qzjvx", "incontrovertibly"))
    assert one._n_fits == sum(map(len, one._fits.values())) < 500
    assert one.encode(text) == before
