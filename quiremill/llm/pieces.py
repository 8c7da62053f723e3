"""SentencePiece BPE encoding and decoding by a table of distinct chunks.

No piece of the vocabulary has a whitespace marker behind another character (checked on loading), so no merge ever joins a
marker to what stands before it: a text is its chunks, each the markers of a run of spaces and the characters up to the next
marker, and each chunk is segmented by itself, wherever it stands.

1. Each task counts the chunks of its texts, some texts at a time, and passes on those that occur more than once among them; the counts are
   added up, and the commonest ``TABLE`` chunks of at most ``SHORT`` characters are the corpus's table, whose size has a bound whatever the corpus.
2. Each of them is segmented once, in a job over the table.
3. Every text is cut again, and each position takes its chunk's ids from the table. Chunks that are not in it (rare or long
   ones) are segmented by the worker that meets them, those of some texts side by side, and remembered in a table of bounded size. So what the table holds changes no result, and texts are
   never shuffled.

Short chunks are merged many at a time in numpy: a row for each, and in each round the best pair of every row.

Defined results: null and empty texts have the end id alone and decode to the empty text; U+2581 in a text is a space, as for
the library; characters that are no piece become the ids of their bytes; strings of control pieces are ordinary text;
repeated rows each have their result; a text of any length takes room in proportion to it; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from functools import cached_property, lru_cache
from itertools import chain, pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.llm._common import default_pieces, dropped, sliced, staged

MARKER = "▁"
#: Most chunks in the table, and their most characters.
TABLE, SHORT = 100_000, 32
#: Characters of texts whose chunks are counted together, and other chunks that a worker remembers.
COUNTED, REMEMBERED = 8_000_000, 200_000
#: Characters of texts whose chunks are looked up together, but for single longer texts, and chunks that are merged side by side.
TOGETHER, ROWS = 500_000, 2048
_CHUNKS = re.compile(" *[^ ]+| +")


class Pairs:
    """Numbers of pairs of ids, in one flat table that numpy looks up many at a time: a pair lies at its hash, or at the next free place."""

    NONE = 1 << 30

    def __init__(self, pairs: dict[tuple[int, int], int]):
        both = np.array(list(pairs), np.int64).reshape(-1, 2)
        keys, numbers = both[:, 0] << 32 | both[:, 1], np.array(list(pairs.values()), np.int32)
        self.bits = max(8, (4 * len(keys)).bit_length())
        self.keys, self.numbers = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE, np.int32)
        at = self._hash(keys)
        while len(keys):
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = first & (self.keys[at] < 0)
            self.keys[at[put]], self.numbers[at[put]] = keys[put], numbers[put]
            keys, numbers, at = keys[~put], numbers[~put], (at[~put] + 1) & (len(self.keys) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The numbers of pairs, ``NONE`` of those without one or with an id below 0."""
        out = np.full(len(left), self.NONE, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[open_].astype(np.int64) << 32 | right[open_]
        at = self._hash(keys)
        while len(open_):
            found = self.keys[at]
            hit = found == keys
            out[open_[hit]] = self.numbers[at[hit]]
            more = np.flatnonzero(~hit & (found >= 0))
            open_, keys, at = open_[more], keys[more], (at[more] + 1) & (len(self.keys) - 1)
        return out


class Pieces:
    """The vocabulary of a model file: merging BPE with byte pieces, a leading marker, and no other normalisation."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trained = model.normalizer_spec, model.trainer_spec
        kinds = proto.ModelProto.SentencePiece
        if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only BPE with byte pieces, a leading marker and no other normalisation is supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.text_of = [p.piece for p in model.pieces]
        self.id_of = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == kinds.NORMAL}
        if any(MARKER in t.lstrip(MARKER) for t in self.id_of):
            raise ValueError("pieces cross whitespace markers, so chunks are not independent")
        self.byte_of = {k: int(p.piece[1:-1], 16) for k, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.bytes = {b: k for k, b in self.byte_of.items()}
        self.silent = {k for k, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.unknown_text = trained.unk_surface
        self.end = sentencepiece.SentencePieceProcessor(model_file=path).eos_id()
        self.shown = {k: t.replace(MARKER, " ") for t, k in self.id_of.items()}
        self.digits = [str(k) for k in range(len(self.text_of))]

    def segment(self, chunk: str) -> list[int]:
        """The ids of a chunk, whose spaces stand for markers: the pair that makes the best piece is merged first, the leftmost of equals."""
        at = list(chunk.replace(" ", MARKER))
        self._merge(at) if len(at) > 40 else self._merge_few(at)
        out = []
        for piece in at:
            if piece is not None:
                k = self.id_of.get(piece)
                out += [k] if k is not None else [self.bytes[b] for b in piece.encode("utf-8")]
        return out

    def _merge_few(self, at: list) -> None:
        """For short chunks: look at all pairs anew."""
        cost, never = self.cost, float("inf")
        costs = [cost.get(a + b, never) for a, b in pairwise(at)]
        while costs:
            least = min(costs)
            if least is never:
                break
            k = costs.index(least)
            at[k : k + 2] = [at[k] + at[k + 1]]
            del costs[k]
            if k < len(costs):
                costs[k] = cost.get(at[k] + at[k + 1], never)
            if k:
                costs[k - 1] = cost.get(at[k - 1] + at[k], never)

    def _merge(self, at: list) -> None:
        """For chunks of any length: pairs wait in a queue; what has been merged into its left neighbour is None."""
        cost, last = self.cost, len(at) - 1
        after, before = list(range(1, len(at) + 1)), list(range(-1, len(at) - 1))
        queue = [(s, k, both) for k, both in enumerate(a + b for a, b in pairwise(at)) if (s := cost.get(both)) is not None]
        heapq.heapify(queue)
        while queue:
            _, k, both = heapq.heappop(queue)
            n = after[k]
            if n > last or at[k] is None or at[k] + at[n] != both:  # an end of it has been merged meanwhile
                continue
            at[k], at[n] = both, None
            after[k] = n = after[n]
            if n <= last:
                before[n] = k
                if (s := cost.get(more := both + at[n])) is not None:
                    heapq.heappush(queue, (s, k, more))
            if (p := before[k]) >= 0 and (s := cost.get(more := at[p] + both)) is not None:
                heapq.heappush(queue, (s, p, more))

    @cached_property
    def _many(self) -> tuple[np.ndarray, np.ndarray, int, Pairs]:
        """(id of each code point, -2 less it if no piece has it, -1 if only longer pieces have it; id of each number, bits, numbers of pairs): a number is the rank of what the pair makes among costs, and in its last ``bits`` the place among pieces of the same cost."""
        made = sorted((t for t in self.id_of if len(t) > 1), key=self.cost.__getitem__)
        numbers, level, place, bits = [], -1, 0, max(Counter(self.cost[t] for t in made).values(), default=1).bit_length()
        for k, t in enumerate(made):
            same = k > 0 and self.cost[t] == self.cost[made[k - 1]]
            level, place = (level, place + 1) if same else (level + 1, 0)
            numbers.append(level << bits | place)
        of_code = -2 - np.arange(0x110000, dtype=np.int32)
        for c in set("".join(self.id_of)):
            of_code[ord(c)] = self.id_of.get(c, -1)
        ids = self.id_of
        pairs = {(ids[t[:i]], ids[t[i:]]): n for n, t in zip(numbers, made, strict=True) for i in range(1, len(t)) if t[:i] in ids and t[i:] in ids}
        id_of = np.zeros(max(numbers, default=0) + 1, np.int32)
        id_of[numbers] = [ids[t] for t in made]
        return of_code, id_of, bits, Pairs(pairs)

    def segment_all(self, some: list[str]) -> list[list[int]]:
        """``segment`` of each chunk, of short ones many at a time."""
        out: list = [None] * len(some)
        short = sorted((k for k, c in enumerate(some) if len(c) <= SHORT), key=lambda k: len(some[k]))
        for at in range(0, len(short), ROWS):
            self._merge_rows(some, short[at : at + ROWS], out)
        return [self.segment(c) if ids is None else ids for c, ids in zip(some, out, strict=True)]

    def _merge_rows(self, some: list[str], places: list[int], out: list) -> None:
        """Puts the ids of chunks, the longest last, in their places; those with a character that only longer pieces have are left out."""
        of_code, id_of, bits, pairs = self._many
        codes = of_code[np.frombuffer("".join([some[k] for k in places]).replace(" ", MARKER).encode("utf-32-le", "surrogatepass"), np.uint32)]
        size = np.array([len(some[k]) for k in places])
        across = int(size[-1]) + 1  # one place more than the longest has, so that each has one behind it
        there = np.arange(across) < size[:, None]
        ids = np.full(there.shape, -1, np.int32)
        ids[there] = codes
        known = ~((ids == -1) & there).any(axis=1)
        cost = np.full(there.shape, Pairs.NONE, np.int32)
        cost[:, :-1] = pairs.of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), across - 1)
        row, cost, ids = np.flatnonzero(known) * across, cost[known], ids.ravel()  # where each row begins; from here on places are those of one flat array
        after = np.arange(1, len(ids) + 1)
        before = after - 2
        while len(row):
            at = (cost >> bits).argmin(axis=1)  # of equals the leftmost
            least = cost[np.arange(len(row)), at]
            going = least != Pairs.NONE
            if not going.all():
                row, cost, at, least = row[going], cost[going], at[going], least[going]
            own, here = np.arange(len(row)), row + at
            gone = after[here]
            behind, ahead = after[gone], before[here]  # a row has a place behind its last
            ids[here], ids[gone] = id_of[least], -1
            after[here], before[behind] = behind, here
            cost[own, gone - row] = Pairs.NONE
            left = np.flatnonzero(at)
            now = pairs.of(np.concatenate([ids[here], ids[ahead[left]]]), np.concatenate([ids[behind], ids[here[left]]]))
            cost[own, at], cost[left, ahead[left] - row[left]] = now[: len(row)], now[len(row) :]
        held = (ids != -1).reshape(there.shape) & known[:, None]
        flat, ends = ids.reshape(there.shape)[held].tolist(), np.cumsum(held.sum(axis=1)).tolist()
        for k, fine, a, z in zip(places, known.tolist(), [0, *ends], ends, strict=False):
            if fine:
                own = flat[a:z]
                out[k] = own if min(own, default=0) >= 0 else [x for i in own for x in ((i,) if i >= 0 else [self.bytes[b] for b in chr(-2 - i).encode("utf-8")])]

    def surface(self, ids) -> str:
        """The text of ids, spaces for markers, without regard to where it stands in a document."""
        try:
            return "".join([self.shown[k] for k in ids])
        except KeyError:  # bytes, control pieces, the unknown piece
            pass
        out, held = [], bytearray()
        for k in ids:
            b = self.byte_of.get(k)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(_from_bytes(bytes(held)))
                held.clear()
            if k not in self.silent:
                out.append(self.unknown_text if k == self.unknown else self.text_of[k].replace(MARKER, " "))
        if held:
            out.append(_from_bytes(bytes(held)))
        return "".join(out)

    def decode(self, ids) -> str:
        """As the library decodes: the space of the leading marker goes, if the first id that is no control piece begins with it."""
        first = next((k for k in ids if k not in self.silent), None)
        text = self.surface(ids)
        return text[1:] if first is not None and first != self.unknown and self.text_of[first].startswith(MARKER) else text

    def encode(self, text: str | None) -> list[int]:
        """The ids of one text and the end id; the job below does the same through the table."""
        return [k for c in chunks(text) for k in self.segment(c)] + [self.end]


def _from_bytes(b: bytes) -> str:
    """UTF-8, each byte that belongs to no character as U+FFFD."""
    out = []
    while b:
        try:
            out.append(b.decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out += [b[: e.start].decode("utf-8"), "�"]
            b = b[e.start + 1 :]
    return "".join(out)


def chunks(text: str | None) -> list[str]:
    """A text's chunks in order, with spaces for markers; together they are the text behind one space."""
    return _CHUNKS.findall(" " + text.replace(MARKER, " ")) if text else []


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(chunk, n): short chunks that some texts hold more than once, with their occurrences there."""

    def run(batches):
        import pyarrow as pa

        def some():
            kept = [(c, n) for c, n in count.items() if n > 1 and len(c) <= SHORT]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["chunk", "n"])

        count, size = Counter(), 0
        for b in sliced(batches):
            for text in b.column(0).to_pylist():
                count.update(chunks(text))
                size += len(text or "")
                if size >= COUNTED:
                    yield some()
                    count, size = Counter(), 0
        yield some()

    return docs.select(docs[text_col].cast("string")).mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The rows with the largest counts, ``most`` at most: those from the least power of a root of two on that leaves no more."""
    level = F.floor(F.log2("n") * 8)
    sizes = counts.groupBy(level.alias("level")).count().collect()  # a few hundred rows
    total, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["level"]):
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return counts.where(level >= least) if least is not None else counts.where("false")


def table(docs: DataFrame, path: str, text_col: str = "text", most: int = TABLE) -> dict[str, list[int]]:
    """The commonest chunks with their ids, each segmented once by Spark; bounded by ``most`` and ``SHORT``."""
    counts = staged(counted(docs, text_col), "pieces")

    def run(batches):
        import pyarrow as pa

        pieces = load(path)
        for b in sliced(batches, 4096):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pieces.segment_all(b.column(0).to_pylist()), pa.list_(pa.int32()))], ["chunk", "ids"])

    found = commonest(counts, most).select("chunk").mapInArrow(run, "chunk string, ids array<int>").collect()
    dropped(counts)
    return {r["chunk"]: list(r["ids"]) for r in found}


class Known(dict):
    """``make(ids)`` of chunks: of all in the table, and of others when they are met; of these at most twice ``most`` are remembered, the latest."""

    def __init__(self, pieces: Pieces, ids_of: dict[str, list[int]], make, most: int = REMEMBERED):
        super().__init__((c, make(ids)) for c, ids in ids_of.items())
        self.pieces, self.make, self.most, self.now, self.before = pieces, make, most, {}, {}

    def __missing__(self, chunk: str):
        value = self.now.get(chunk)
        if value is None:
            value = self.before.get(chunk)
            if value is None:
                value = self.make(self.pieces.segment(chunk))
            self._remember(chunk, value)
        return value

    def _remember(self, chunk: str, value) -> None:
        if len(self.now) >= self.most:
            self.before, self.now = self.now, {}
        if len(chunk) <= SHORT:
            self.now[chunk] = value

    def of(self, texts: list[str | None]):
        """The values of each text's chunks in order; what some texts hold of short chunks that are not known yet is segmented side by side."""
        for some in together(texts):
            cut = [chunks(t) for t in some]
            new = [c for c in dict.fromkeys(chain.from_iterable(cut)) if c not in self and c not in self.now and c not in self.before and len(c) <= SHORT]
            for c, ids in zip(new, self.pieces.segment_all(new), strict=True):
                self._remember(c, self.make(ids))
            for found in cut:
                yield [self[c] for c in found]


def together(texts: list[str | None]):
    """Texts in order, ``TOGETHER`` characters at a time, one text at least."""
    some, size = [], 0
    for t in texts:
        n = len(t or "")
        if some and size + n > TOGETHER:
            yield some
            some, size = [], 0
        some.append(t)
        size += n
    if some:
        yield some


def encoded(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int> with the end id, decoded string) of every text."""
    path = model or default_pieces()
    shipped = docs.sparkSession.sparkContext.broadcast(table(docs, path, text_col))

    def run(batches):
        import pyarrow as pa

        pieces = load(path)
        known = Known(pieces, shipped.value, lambda ids: ids)
        for b in sliced(batches):
            ids = [[*chain.from_iterable(found), pieces.end] for found in known.of(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(pieces.decode, ids), pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row per document: n_tokens, and SHA-256 of the ids and of the text decoded from them."""
    path = model or default_pieces()
    shipped = docs.sparkSession.sparkContext.broadcast(table(docs, path))

    def run(batches):
        import pyarrow as pa

        pieces = load(path)
        digits = pieces.digits
        known = Known(pieces, shipped.value, lambda ids: (" ".join([digits[k] for k in ids]), pieces.surface(ids)))
        end = str(pieces.end)
        for b in sliced(batches):
            n, of_ids, of_text = [], [], []
            for found in known.of(b.column(1).to_pylist()):
                numbers = " ".join([*[x[0] for x in found], end])
                n.append(numbers.count(" ") + 1)
                of_ids.append(hashlib.sha256(numbers.encode()).hexdigest())
                of_text.append(hashlib.sha256("".join([x[1] for x in found])[1:].encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
