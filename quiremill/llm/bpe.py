"""BPE by dynamic programming over prefixes.

For each prefix of a word there is exactly one token that its encoding ends with. A suffix automaton
of all tokens follows the longest suffix of the prefix that occurs in a token; the tokens that are
suffixes of the prefix lie on the way of suffix links from there. The one whose predecessor (the last
token of the prefix before it) is compatible is stored, and following these back-pointers from the end
gives the ids.

Two tokens are compatible if merging never prefers a pair across their border. With merge ranks that
only grow upwards (checked before the first word is encoded), the piece of the left token that touches the border has a
known life in ranks, and so has the piece of the right one; a merge of two pieces whose lives both
contain its rank rules the pair out. At equal rank the left merge goes first.

Defined results: null and empty texts have no ids; the strings of special tokens in a text become
their ids, as in the library's default; very long words are one linear scan. Words are encoded once
per worker and remembered in a table of bounded size. The automaton and the merges are made when a word is first encoded; who only cuts
words, such as packing and token files, holds neither.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cached_property, lru_cache
from itertools import chain

from pyspark.sql import DataFrame

from quiremill.llm._common import default_vocabulary, sliced
from quiremill.llm.automaton import suffix_automaton

#: Unicode White_Space, as fixed values.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The vocabulary's own pattern of words (a fixed value of its file), for ASCII.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: The same with Latin-1's and Cyrillic letters, each of which is one composed character with one lower case in all versions of Unicode.
_LETTERED = re.compile("[\0-\x7fÀ-ÖØ-öø-ÿЀ-џ]+")
_LETTERED_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿа-џ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿа-џ]+")
_PIECES = re.compile(f"[^{_SPACE}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_END = "</w>"
#: Added to a final atom's code so that it differs from the same atom inside a word.
_FINAL = 0xE000
_FOREVER = 1 << 60


def _byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level BPE: printable Latin-1 stays, the rest goes to U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo(dict):
    """A function's results by word. At most ``most`` recent ones are held, and as many before these; older ones are forgotten."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, word):
        value = self.before.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.before = self.copy()
                self.clear()
            self[word] = value
        return value


class WordBpe:
    def __init__(self, path: str, remember: int = 100_000):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self._path, spec = path, self._file(path)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != _END or model.get("byte_fallback") or model.get("ignore_merges") or spec["decoder"] is not None:
            raise ValueError("only byte-level BPE with word ends and without a decoder is supported")
        split, *rest = spec["pre_tokenizer"].get("pretokenizers", [{"type": None}])
        if split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"] or [(p["type"], p["use_regex"], p["add_prefix_space"]) for p in rest] != [("ByteLevel", False, False)]:
            raise ValueError("only words cut by one pattern and taken as bytes are supported")
        # what letters and numbers are, and how they are lower-cased, depends on the library's Unicode tables; other pieces than of ``_LETTERED`` are therefore left to it
        self._normal = Tokenizer.from_file(path).normalizer
        self._cut = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.text_of = {i: t for t, i in model["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.text_of |= {i: t for t, i in self.special.items()}
        self.size = max(self.text_of) + 1
        self._special_re = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._letters = _byte_letters()
        self._table = {b: c for b, c in self._letters.items()}

        # for each token: whether it may follow another
        self._fits: dict[int, dict[int, bool]] = {}
        self._n_fits = 0
        self.ids_of = self.memo(self.encode_word, lambda v: tuple(chain.from_iterable(v)), remember)

    @staticmethod
    def _file(path: str) -> dict:
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    @cached_property
    def _merges(self) -> tuple[dict[int, int], dict[int, tuple[int, int]], dict[int, int]]:
        """The rank that makes each token, its two parts, and the rank of each pair of tokens."""
        model = self._file(self._path)["model"]
        vocab: dict[str, int] = model["vocab"]
        born: dict[int, int] = {}
        parts: dict[int, tuple[int, int]] = {}
        rank_of: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            if whole in parts or born.get(a, -1) >= rank or born.get(b, -1) >= rank:
                raise ValueError("merges must make each token once, and its parts before it")
            born[whole], parts[whole], rank_of[a << 32 | b] = rank, (a, b), rank
        return born, parts, rank_of

    @cached_property
    def _automaton(self) -> tuple[list[dict], list[int], list[int], list[tuple]]:
        """The suffix automaton of the tokens, and for each state the tokens that end its strings as (length, id, ``_fits`` of it), longest first: its own, and those of the states that its suffix links lead to."""
        vocab = self._file(self._path)["model"]["vocab"]
        tokens = sorted((atoms, i) for text, i in vocab.items() if (atoms := self._as_atoms(text)))
        step, link, length = suffix_automaton(*(atoms for atoms, _ in tokens))
        ends: list[tuple] = [()] * len(step)
        for atoms, i in reversed(tokens):
            state = 0
            for c in atoms:
                state = step[state][c]
            ends[state] = (*sorted((*ends[state], (len(atoms), i, self._fits.setdefault(i, {}))), key=lambda e: e[:2], reverse=True),)
        for state in sorted(range(1, len(step)), key=length.__getitem__):
            ends[state] += ends[link[state]]
        return step, link, length, ends

    def _as_atoms(self, text: str) -> str:
        if text.endswith(_END) and len(text) > len(_END):
            body = text[: -len(_END)]
            return body[:-1] + chr(_FINAL + ord(body[-1]))
        return text

    def _left_lives(self, token: int) -> list[tuple[int, int, int]]:
        """The pieces at the token's right border: (piece, rank that makes it, rank that uses it up)."""
        born_of, parts, _ = self._merges
        lives, until = [], _FOREVER
        while True:
            born = born_of.get(token, -1)
            lives.append((token, born, until))
            if born < 0:
                return lives
            token, until = parts[token][1], born

    def _right_lives(self, token: int) -> list[tuple[int, int, int]]:
        born_of, parts, _ = self._merges
        lives, until = [], _FOREVER
        while True:
            born = born_of.get(token, -1)
            lives.append((token, born, until))
            if born < 0:
                return lives
            token, until = parts[token][0], born

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' joint text is just these two."""
        found = self._fits.setdefault(right, {})
        known = found.get(left)
        if known is None:
            known = True
            ends, rank_of = self._right_lives(right), self._merges[2]
            for a, a_born, a_until in self._left_lives(left):
                for b, b_born, b_until in ends:
                    rank = rank_of.get(a << 32 | b)
                    if rank is not None and a_born < rank < a_until and b_born < rank <= b_until:
                        known = False
                        break
                if not known:
                    break
            if self._n_fits >= 500_000:
                for of_token in self._fits.values():
                    of_token.clear()
                self._n_fits = 0
            found[left] = known
            self._n_fits += 1
        return known

    def letters(self, word: str) -> str:
        """A word's bytes as their printable stand-ins."""
        return word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self._table)

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The ids of one word of the pattern (already normalised)."""
        atoms = self.letters(word)
        atoms = atoms[:-1] + chr(_FINAL + ord(atoms[-1]))
        last, start = [-1] * (len(atoms) + 1), [0] * (len(atoms) + 1)
        step, link, length, ends = self._automaton
        state = held = end = 0
        for c in atoms:
            to = step[state].get(c)
            while to is None:  # every single character is a token
                state = link[state]
                held = length[state]
                to = step[state].get(c)
            state = to
            held += 1
            end += 1
            for size, token, fits in ends[state]:
                if size > held:  # the state's longer strings are not in the word
                    continue
                if begin := end - size:
                    before = last[begin]
                    ok = fits.get(before)
                    if ok is None:
                        ok = before >= 0 and self.fits(before, token)
                    if not ok:
                        continue
                last[end], start[end] = token, begin
                break
        ids, at = [], len(atoms)
        while at:
            ids.append(last[at])
            at = start[at]
        return tuple(reversed(ids))

    def words_of(self, piece: str) -> list[str]:
        """The normalised words of what stands between white space. Composing, lower-casing and cutting never reach across white space."""
        if piece.isascii():
            piece = piece.lower()
            return [piece] if piece.isalpha() else _WORDS.findall(piece)
        if _LETTERED.fullmatch(piece):
            piece = piece.lower()
            return [piece] if piece.isalpha() else _LETTERED_WORDS.findall(piece)
        return [w for w, _ in self._cut.pre_tokenize_str(self._normal.normalize_str(piece))]

    def memo(self, one, join, most: int) -> Memo:
        """Values of what stands between white space: ``one`` word's value, or ``join`` of its words' values."""

        def make(piece: str):
            words = self.words_of(piece)
            return of_word[words[0]] if len(words) == 1 and words[0] != piece else one(piece) if len(words) == 1 else join([of_word[w] for w in words])

        of_word = Memo(one, most // 2)
        return Memo(make, most)

    def values(self, text: str | None, memo: Memo, of_special) -> list:
        """The values of a text's pieces and, by ``of_special``, of its special tokens, in order."""
        if not text:
            return []
        if any(s in text for s in self.special):
            parts = self._special_re.split(text)
            return [v for i, part in enumerate(parts) for v in ([of_special(self.special[part])] if i % 2 else self.values(part, memo, of_special))]
        if text.isascii():
            text = text.lower()
        # these four part words for str.split, but are no Unicode white space
        pieces = _PIECES.findall(text) if _SEPARATORS.search(text) else text.split()
        return list(map(memo.__getitem__, pieces))

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.values(text, self.ids_of, lambda i: (i,)) for i in ids]

    def decode(self, ids) -> str:
        return " ".join([self.text_of[i] for i in ids])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encoded(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every text."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        import pyarrow as pa

        bpe = load(path)
        for b in sliced(batches):
            ids = [bpe.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document: n_tokens, and SHA-256 of the ids and of the decoded text. No shuffle; texts never leave their task."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        import pyarrow as pa

        bpe = load(path)

        def both(word):
            ids = bpe.encode_word(word)
            return " ".join(map(str, ids)), bpe.decode(ids)

        memo = bpe.memo(both, lambda v: (" ".join([x[0] for x in v]), " ".join([x[1] for x in v])), 200_000)
        for b in sliced(batches):
            n, of_ids, of_text = [], [], []
            for text in b.column(1).to_pylist():
                found = bpe.values(text, memo, lambda i: (str(i), bpe.text_of[i]))
                numbers = " ".join([x[0] for x in found])
                n.append(numbers.count(" ") + 1 if found else 0)
                of_ids.append(hashlib.sha256(numbers.encode()).hexdigest())
                of_text.append(hashlib.sha256(" ".join([x[1] for x in found]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
