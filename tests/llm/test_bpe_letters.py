"""Words with common letters are cut without the library, as it cuts them, and remembered by a worker through all its tasks."""

import random

from quiremill.llm import bitpack, bpe
from quiremill.llm._common import default_vocabulary


def test_lettered_pieces_are_cut_as_by_the_library(monkeypatch):
    own = bpe.load(default_vocabulary())
    chars = [c for c in map(chr, range(0x3000)) if bpe._LETTERED.fullmatch(c) and not c.isspace()]
    assert len(chars) > 250
    pick = random.Random(3)
    pieces = [*chars, *(a + b for c in chars for a, b in ((c, "'s"), ("x'", c), ("1", c), (c, "."), ("É", c), (c, "ь"))), *("".join(pick.choices(chars, k=pick.randint(2, 7))) for _ in range(20_000))]
    pieces = [p for p in pieces if not p.isascii()]
    want = [[w for w, _ in own._cut.pre_tokenize_str(own._normal.normalize_str(p))] for p in pieces]
    monkeypatch.setattr(own, "_normal", None)
    assert [own.words_of(p) for p in pieces] == want


def test_words_are_remembered_through_tasks(monkeypatch):
    """Each task of ``bitpack.write`` asks for the encoder anew."""
    bitpack.lasting_encoder.cache_clear()
    calls, own = [], bpe.WordBpe.words_of
    monkeypatch.setattr(bpe.WordBpe, "words_of", lambda self, piece: calls.append(piece) or own(self, piece))
    first, second = (bitpack.lasting_encoder(default_vocabulary())("Überraschend viele words, words") for _ in range(2))
    assert first == second and len(first) >= 20 and len(calls) == 4


def test_who_only_cuts_words_holds_no_automaton(monkeypatch):
    bpe.load.cache_clear()
    monkeypatch.setattr(bpe, "suffix_automaton", lambda *texts: 1 / 0)
    assert len(bitpack.library_encoder(default_vocabulary())("Viele words, <und> mehr")) >= 16
    assert not {"_automaton", "_merges"} & vars(bpe.load(default_vocabulary())).keys()
