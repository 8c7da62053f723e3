"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text is built; a text is parsed from left to right into the longest
phrases that occur in that text, across words, and the language that needs the fewest phrases wins. A phrase costs the same
in every language, log2 of the longest automaton's text length, so that a language with little text has no cheaper phrases; costs are divided by the letters parsed. Texts are lower-cased letters and marks, with one
space for everything between them. They are parsed whole, in stretches of ``STRETCH`` letters at whose ends a phrase ends;
many stretches go through an automaton's flat tables at a time in numpy.

What is learned from: of each value of ``lang`` about ``docs_per_language`` rows, chosen by a hash of the id, and of each of
these one passage; together ``letters_per_language`` letters form the automaton's text, and ``letters_in_all`` those of all
languages (``LEAST_LETTERS`` a language at any rate, so that every value is learned: the broadcast tables are bounded for each
language, and grow with the number of languages alone). Every letter of these passages is learned, however many there are.
One passage in five is held back. The most bits a letter that these need, or the language's own letters in random order, are
taken as what its texts can need; a text counts as none of the learned languages beyond the middle between that and the
bits of a text whose every letter is unknown.

A language is learned if its passages hold a letter.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything if nothing could be
learned; ties go to the smaller language value; rows with null lang or null or empty text are scored but not learned from;
rows with null id are learned from like others; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.llm._common import sliced
from quiremill.llm.automaton import Packed, suffix_automaton

UNKNOWN = "und"
#: Letters parsed in one go.
STRETCH = 256
#: Stretches that go through the tables side by side.
LANES = 4096
#: Letters that are turned to numbers together; bounds a worker's memory but for single longer texts.
ROOM = 1_000_000
LEAST_LETTERS = 2_000
#: Texts of fewer letters are too short to be told from random ones, and are accepted.
SURE = 40


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each code point: 1 for letters, 2 for marks, 0 for the rest."""
    first = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    return np.fromiter(({"L": 1, "M": 2}.get(k, 0) for k in first), np.uint8, len(first))


def letters_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, begin of each text and the end of the last, whether each has a letter): lower-cased letters and marks, every run of others one space; texts begin with a space."""
    plain = [" " + t.lower() if t else " " for t in texts]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in plain], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    kind = _kinds()[codes]
    space = kind == 0
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[begin[:-1]] = True
    keep[begin[1:-1] - 1] &= ~space[begin[1:-1] - 1] | (lengths[:-1] == 1)  # the next text begins with a space of its own
    total = np.concatenate([[0], np.cumsum(keep)])
    has = np.add.reduceat(kind == 1, begin[:-1], dtype=np.int64) > 0 if len(texts) else np.zeros(0, bool)
    return np.where(space, np.uint32(32), codes)[keep], total[begin], has


class Model:
    """Languages, and for each its automaton, the bits of a phrase (one number for all) and the most bits a letter of a text in it."""

    def __init__(self, passages: dict[str, list[str]], letters_per_language: int = 120_000):
        self.automata, self.bits, self.most = [], [], []
        learned, held = {}, {}
        for name in sorted(passages):
            parts = [c[a:z] for c, at, has in [letters_of(passages[name])] for a, z, letter in zip(at[:-1], at[1:], has, strict=True) if letter]
            if not parts:
                continue
            held[name] = parts[4::5]
            rest = [x for k, x in enumerate(parts) if k % 5 != 4]
            learned[name] = np.concatenate([*rest, np.array([32], np.uint32)])[:letters_per_language]
        self.languages = list(learned)
        price = math.log2(max(map(len, learned.values()), default=1) + 1)
        self.alphabet = np.unique(np.concatenate([*learned.values(), np.array([32], np.uint32)])) if learned else np.empty(0, np.uint32)
        for name in self.languages:
            symbols = np.searchsorted(self.alphabet, learned[name]) + 1
            self.automata.append(Packed(suffix_automaton(symbols.tolist())[0], len(self.alphabet) + 1))
            self.bits.append(price)
        for k, name in enumerate(self.languages):
            self.most.append(self._bound(k, learned[name], held[name]))

    def _bound(self, k: int, learned: np.ndarray, held: list[np.ndarray]) -> float:
        mixed = np.random.default_rng(3).permutation(learned)[:20_000]
        at = np.array([0, len(mixed)])
        noise = float(self.parsed(mixed, at)[0, k]) * self.bits[k] / max(1, len(mixed))
        long = [x for x in held if len(x) >= SURE]
        if not long:
            return (noise + self.bits[k]) / 2
        at = np.concatenate([[0], np.cumsum([len(x) for x in long])])
        own = self.parsed(np.concatenate(long), at)[:, k] * self.bits[k] / np.diff(at)
        return (max(noise, float(own.max())) + self.bits[k]) / 2

    @property
    def table(self) -> np.ndarray:
        """The symbol of each code point, 0 for letters that were not learned."""
        out = np.zeros(0x110000, np.int32)
        out[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return out

    def parsed(self, codes: np.ndarray, at: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """[text, language]: the phrases of texts given by code points and their begins."""
        symbols = (self.table if table is None else table)[codes]
        lengths = np.diff(at)
        pieces = -(-lengths // STRETCH)
        text = np.repeat(np.arange(len(lengths)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = at[:-1][text] + number * STRETCH
        size = np.minimum(at[1:][text] - begin, STRETCH)
        order = np.argsort(-size, kind="stable")
        out = np.zeros((len(lengths), len(self.languages)), np.int64)
        for k in range(0, len(order), LANES):
            some = order[k : k + LANES]
            places = np.arange(int(size[some[0]]))[:, None] + begin[some]
            columns = symbols[np.minimum(places, len(symbols) - 1)]
            for lang, automaton in enumerate(self.automata):
                out[:, lang] += np.bincount(text[some], automaton.phrases(columns, size[some]), len(lengths)).astype(np.int64)
        return out


def fit(docs: DataFrame, docs_per_language: int = 400, letters_per_language: int = 120_000, letters_in_all: int = 2_000_000, seed: int = 5) -> Model:
    """Learn from all given rows that have a language and a text."""
    text = F.col("text").cast("string")
    known = docs.select("doc_id", text.alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null and text != ''")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model({})
    letters = min(letters_per_language, max(LEAST_LETTERS, letters_in_all // len(counts)))
    scale = 1 << 40
    # of each language: rows below this hash are chosen, and this many characters of each
    pick = {name: (min(scale, scale * docs_per_language // n), max(64, 2 * letters // min(n, docs_per_language))) for name, n in counts.items()}
    sizes = docs.sparkSession.createDataFrame([(name, below, size) for name, (below, size) in pick.items()], "lang string, below long, size int")
    order = F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64), F.lit(seed)), F.lit(scale))
    chosen = known.join(F.broadcast(sizes), "lang").withColumn("at", order).where("at < below")  # a row for each language
    begin = F.pmod(F.xxhash64("at"), F.greatest(F.length("text") - F.col("size"), F.lit(0)) + 1)
    rows = chosen.select("lang", "at", F.substring("text", (begin + 1).cast("int"), F.col("size")).alias("passage")).collect()
    passages: dict[str, dict[str, None]] = {name: {} for name in counts}
    for r in sorted(rows, key=lambda r: (r["lang"], r["at"], r["passage"])):
        passages[r["lang"]][r["passage"]] = None  # copies count once
    return Model({name: list(some) for name, some in passages.items() if some}, letters)


class Scorer:
    """Predictions for texts."""

    def __init__(self, model: Model):
        self.model, self.table = model, model.table
        self.price, self.most = np.array(model.bits), np.array(model.most)

    def of(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[bool]]:
        """Language, score, bits a letter and whether it is accepted as that language, of each text."""
        out: tuple[list, list, list, list] = ([], [], [], [])
        at = 0
        while at < len(texts):  # as many as fit the room, one at least
            end, room = at + 1, ROOM - len(texts[at] or "")
            while end < len(texts) and (room := room - len(texts[end] or "")) >= 0:
                end += 1
            for whole, some in zip(out, self._of(texts[at:end]), strict=True):
                whole.extend(some)
            at = end
        return out

    def _of(self, texts: list[str | None]):
        languages = self.model.languages
        codes, at, has = letters_of(texts)
        if not languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [True] * len(texts)
        n = np.diff(at)
        each = self.model.parsed(codes, at, self.table) * self.price / np.maximum(n, 1)[:, None]
        best = each.argmin(axis=1)
        bits = each[np.arange(len(texts)), best]
        rest = np.partition(each, 1, axis=1)[:, 1] if len(languages) > 1 else np.full(len(texts), np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(np.isinf(rest), 1.0, np.where(rest + bits > 0, rest / (rest + bits), 0.5))
        fine = has & ((bits <= self.most[best]) | (n < SURE))
        return [languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, score, 0.0).tolist(), np.where(has, bits, 0.0).tolist(), fine.tolist()


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and bits (per letter, of the winner) of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit()

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(shipped.value)
        for b in sliced(batches, 512):
            pred, score, bits, _ = scorer.of(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], ["doc_id", "lang_pred", "score", "bits"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, bits double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` in one of the learned languages, all columns as they were: not ``und``, and parsed in no more bits a letter than that language's bound. All rows where nothing was learned."""
    if not model.languages:
        return docs
    shipped, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    where = names.index("text")

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(shipped.value)
        for b in sliced(batches, 512):
            yield b.filter(pa.array(scorer.of(b.column(where).cast(pa.string()).to_pylist())[3], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predicted(docs: DataFrame, **options) -> DataFrame:
    """Every document identified by a model of the rows outside the held-out fold (crc32 of the id's text mod 4 = 2)."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = fit(docs.where(fold != 2), **options)
    return identified(docs, model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits")
