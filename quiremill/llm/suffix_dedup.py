"""Passages that repeat across documents, by sparse suffix arrays.

A text is its words (runs of ``[^\\x20\\x09-\\x0D]``, A-Z in lower case) as 64-bit hashes. Of all
suffixes only those are retained that begin at a minimiser: the position with the least hash of the
next ``gram`` words within a window. A window and a gram together are no longer than ``least`` words,
so any passage of ``least`` words retains a suffix inside it, at the same place in each of its copies.

1. One scan writes the retained places and grams. Grams that stand in one document alone can be in no
   repeated passage and go, which leaves the work in proportion to what repeats.
2. A second scan writes the retained suffixes of the others, with the words around the gram (a window to
   the left, and on the right as many as make ``least`` with it). They are sorted by gram and following words, over
   ranges of even size: equal keys are split by document, so a very common passage fills no task.
3. Each suffix is compared with its nearest neighbours from other documents on either side in that
   order (the nearest at any distance, and those up to ``REACH`` rows away), and the match is extended to the left and right; one of ``least`` words or more marks its span
   in both documents.
4. In a group of more rows, or one that goes on in the next range, a partner whose words agree before the gram too can
   stand further away than these. There each window of ``least`` words around the minimiser goes by its hash to the others that
   are equal, but for those that the nearest neighbours' right match shows to be in one document, and
   those found equal to an earlier row's, which speaks for them (``met`` says that it has met one).
   Windows in two documents are spans. Hashes are combined within each task first, so a passage that
   a third of all documents hold is a few rows, and no range needs to see another one's rows.
5. A document's spans are joined where they touch. Minimisers inside a longer passage are at most a
   window apart, so its spans cover it from end to end.

A document that repeats a passage only within itself has no span.

Defined results: null, empty and short texts have no span; copies of a whole document are one span
from end to end; rows with equal ids are one document; null ids take no part; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.llm._common import dropped, sliced, staged
from quiremill.llm.words import _ODD, Words, mixed, runs

#: Words beyond either end of a text, one kind for each end and document: they match nothing.
_EDGE = np.uint64(0)
#: Rows on either side that a suffix is compared with, besides the nearest of another document: the nearest one's words
#: after the minimiser agree furthest, but another's may agree before it as well. Partners further away are found by windows.
REACH = 6
#: Rows of one table of suffixes that the next one's are compared with, at most; further ones are found by windows.
MOST_HELD = 4096


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the least value of some ``window`` neighbouring ones (the last of equal ones)."""
    n = len(grams)
    if n <= window:
        return np.array([n - 1 - int(grams[::-1].argmin())]) if n else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams[::-1], window)
    found = [np.unique(views[a : a + 65536].argmin(axis=1) + np.arange(a, min(a + 65536, len(views)))) for a in range(0, len(views), 65536)]
    return n - 1 - np.unique(np.concatenate(found))[::-1]


def _retained(words: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the retained suffixes."""
    if len(words) < gram + window - 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = runs(words, gram)
    at = minimisers(grams, window)
    return at, grams[at]


def _matched(left: np.ndarray, right: np.ndarray, keys: np.ndarray, other: np.ndarray):
    """Rows whose gram is that of the row ``other`` (-1: none), that row, and how many words match to the gram's left and right."""
    rows = np.flatnonzero(other >= 0)
    rows = rows[keys[rows] == keys[other[rows]]]
    partner = other[rows]

    def reach(side):
        same = (side[rows] == side[partner]) & (side[rows] != _EDGE)
        return np.where(same.all(axis=1), side.shape[1], same.argmin(axis=1))

    return rows, partner, reach(left), reach(right)


def _neighbours(docs: np.ndarray) -> np.ndarray:
    """For each row the last row before it that is of another document; -1 if there is none."""
    n = len(docs)
    change = np.flatnonzero(docs[1:] != docs[:-1]) if n else np.empty(0, np.int64)
    at = np.searchsorted(change, np.arange(n))  # changes before row i lie at change < i
    return np.where(at > 0, change[np.maximum(at - 1, 0)], -1) if len(change) else np.full(n, -1)


def _bits(low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """Numbers whose bits ``low`` to ``high``, of ``width``, are set."""
    one = np.int64(1)
    return np.where(high >= low, (one << np.clip(high + 1, 0, width)) - (one << np.clip(low, 0, width)), 0)


def _compare(table, least: int, gram: int):
    """From sorted suffixes with their contexts: spans (doc_id, start, end), and windows (hash, doc_id, start, met) whose partners may stand further away."""
    if not table.num_rows:
        return np.empty((0, 3), np.int64), np.empty((0, 4), np.int64)
    keys, docs, at = (table.column(c).to_numpy() for c in ("key", "doc_id", "at"))
    right, left = (np.frombuffer(b"".join(table.column(c).to_pylist()), ">u8").reshape(table.num_rows, -1).astype(np.uint64) for c in ("right", "left"))
    n, width = len(docs), left.shape[1]
    before = _neighbours(docs)
    # the neighbour after a row is the row whose neighbour before it is in its document, unless several rows of one document stand together
    after = n - 1 - _neighbours(docs[::-1])[::-1]
    after = np.where(after < n, after, -1)
    # all matches of a row hold its gram, so together they are one span
    begin, end = at.copy(), at.copy()
    # bit s is for the window that begins s words before the minimiser: met in another document, and in that of a row before
    met, earlier, furthest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    steps = [np.arange(n) - d for d in range(1, REACH + 1)]
    for turn, other in enumerate((before, after, *(np.where((j >= 0) & (docs[np.maximum(j, 0)] != docs) & (j != before), j, -1) for j in steps))):
        rows, partner, a, z = _matched(left, right, keys, other)
        z += gram
        furthest[rows] = np.maximum(furthest[rows], z)
        ok = a + z >= least
        rows, partner, a, z = rows[ok], partner[ok], a[ok], z[ok]
        bits = _bits(least - z, np.minimum(a, width - 1), width)
        met[rows] |= bits
        begin[rows], end[rows] = np.minimum(begin[rows], at[rows] - a), np.maximum(end[rows], at[rows] + z)
        if turn != 1:
            earlier[rows] |= bits
            np.bitwise_or.at(met, partner, bits)
            np.minimum.at(begin, partner, at[partner] - a), np.maximum.at(end, partner, at[partner] + z)
    some = np.flatnonzero(end > begin)
    spans = np.unique(np.stack([docs[some], begin[some], end[some]], axis=1), axis=0)
    return spans, _windows(keys, docs, at, left, right, before, after, met, earlier, furthest, least, gram)


def _windows(keys, docs, at, left, right, before, after, met, earlier, furthest, least: int, gram: int) -> np.ndarray:
    n, width = left.shape
    change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    bounds = np.concatenate([[0], change, [n]])
    group = np.searchsorted(change, np.arange(n), "right")
    first, last = bounds[group], bounds[group + 1]
    # rows of a small group have all met one another; one at the table's border may go on beyond it
    large = (first == 0) | (last == n) | (last - first > REACH + 1)
    unknown = ((first == 0) & (before < 0)) | ((last == n) & (after < 0))
    words = lambda side: np.where((side == _EDGE).any(axis=1), (side == _EDGE).argmax(axis=1), side.shape[1])
    reach = np.minimum(np.where(unknown, least, furthest), words(right) + gram)
    wanted = np.where(large, _bits(least - reach, np.minimum(words(left), width - 1), width) & ~earlier, 0)
    rows = np.flatnonzero(wanted)
    if not len(rows):
        return np.empty((0, 4), np.int64)
    # every window holds the whole gram, which counts as one symbol
    around = np.concatenate([left[rows, ::-1], keys[rows, None].view(np.uint64), right[rows]], axis=1)
    size = least - gram + 1
    sums = np.zeros((around.shape[1] + 1, len(rows)), np.uint64)
    for j in range(around.shape[1]):
        sums[j + 1] = sums[j] * _ODD + around[:, j]
    power = np.uint64(pow(int(_ODD), size, 1 << 64))
    out = []
    for s in range(width):
        some = np.flatnonzero(wanted[rows] >> s & 1)
        who, start = rows[some], width - s
        # the place of the gram in the window is part of the hash
        value = mixed(sums[start + size, some] - sums[start, some] * power + np.uint64(s))
        out.append(np.stack([value.view(np.int64), docs[who], at[who] - s, met[who] >> s & 1], axis=1))
    return np.concatenate(out)


def repeated(docs: DataFrame, least: int = 50, gram: int = 20, range_rows: int = 50_000) -> DataFrame:
    """One row per repeated passage: doc_id, start_word, end_word (exclusive), n_words."""
    window = least - gram + 1
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("doc_id is not null")

    def places(batches):
        import pyarrow as pa

        known = Words()
        for b in sliced(batches):
            ids, keys, ats = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, key = _retained(known.of(text), gram, window)
                ids.append(np.full(len(at), doc_id)), keys.append(key.view(np.int64)), ats.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (ids, keys, ats)], ["doc_id", "key", "at"])

    retained = staged(rows.mapInArrow(places, "doc_id long, key long, at long"), "suffix-retained")
    # in two documents or more: the least id differs from the greatest
    again = staged(retained.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("key"), "suffix-again")
    wanted = staged(retained.join(again, "key", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_list("at")).alias("ats")), "suffix-places")

    def contexts(batches):
        import pyarrow as pa

        known = Words()
        for b in sliced(batches, 64):
            ids, keys, ats, lefts, rights = [], [], [], [], []
            for doc_id, text, chosen in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = known.of(text)
                words = np.where(words == _EDGE, np.uint64(1), words)
                at = np.array(chosen, np.int64)
                padded = np.concatenate([np.zeros(window, np.uint64), words, np.zeros(least, np.uint64)])
                rights += map(bytes, padded[at[:, None] + (window + gram + np.arange(least - gram))].astype(">u8"))
                lefts += map(bytes, padded[at[:, None] + (window - 1 - np.arange(window))].astype(">u8"))
                keys.append(runs(words, gram)[at].view(np.int64)), ids.append(np.full(len(at), doc_id)), ats.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(ats)), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())], ["key", "doc_id", "at", "left", "right"])

    shape = "key long, doc_id long, at long, left binary, right binary"
    suffixes = rows.join(wanted, "doc_id").select("doc_id", "text", "ats").mapInArrow(contexts, shape)
    order = ["key", "right", "doc_id", "at"]
    context = staged(suffixes, "suffix-contexts")
    # ranges of so many rows each: merged by their compressed bytes, as adaptive plans would, ranges of copies would be far larger than others
    ranges = max(1, -(-context.count() // range_rows))
    dealt = context.repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    def compare(batches):
        """Spans (met null), and windows (key: hash, end: null)."""
        import pyarrow as pa

        held = None
        for b in batches:
            table = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
            spans, windows = _compare(table, least, gram)
            n = len(spans)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), *(pa.array(spans[:, j]) for j in range(3)), pa.nulls(n, pa.int64())], list(shape_out))
            for k in range(0, len(windows), 65536):
                some = windows[k : k + 65536]
                yield pa.RecordBatch.from_arrays([*(pa.array(some[:, j]) for j in range(3)), pa.nulls(len(some), pa.int64()), pa.array(some[:, 3])], list(shape_out))
            held = _last(table)

    def _last(table):
        """The last suffixes of a table that the next one's are compared with: up to one of a second document, and no more than can be neighbours."""
        ids = table.column("doc_id").to_numpy()
        other = np.flatnonzero(ids != ids[-1]) if len(ids) else ids
        return table.slice(max(0, min(int(other[-1]), len(ids) - REACH), len(ids) - MOST_HELD) if len(other) else max(0, len(ids) - MOST_HELD))

    shape_out = dict.fromkeys(("key", "doc_id", "at", "end", "met"), "long")
    compared = staged(dealt.mapInArrow(compare, ", ".join(f"{k} {v}" for k, v in shape_out.items())), "suffix-compared")
    dropped(retained, again, wanted, context)
    # windows in two documents, or known to be
    windows = compared.where("met is not null").select("key", "doc_id", "at", "met")
    shared = staged(windows.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.max("met").alias("met")).where("a < z or met = 1").select("key"), "suffix-windows")
    apart = windows.where("met = 0").join(shared, "key", "left_semi").select("doc_id", "at", (F.col("at") + least).alias("end"))
    spans = compared.where("met is null").select("doc_id", "at", "end").union(apart)

    def join(batches):
        import pyarrow as pa

        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for doc_id, some in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                begin, end = None, -1
                for s in some:
                    if s["at"] > end:
                        if begin is not None:
                            out[0].append(doc_id), out[1].append(begin), out[2].append(end)
                        begin, end = s["at"], s["end"]
                    end = max(end, s["end"])
                out[0].append(doc_id), out[1].append(begin), out[2].append(end)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start_word", "end_word"])

    by_doc = spans.distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "end"))).alias("spans"))
    return by_doc.mapInArrow(join, "doc_id long, start_word long, end_word long").withColumn("n_words", F.col("end_word") - F.col("start_word"))
