"""SentencePiece chunks, whitening and the audit of sources against the library, brute force and SQL, and on odd rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiremill.llm import divergence, pieces, queries, whitening
from quiremill.llm._common import default_pieces
from tests.llm.test_llm import DOCS, ODD
from tests.oracle import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in ODD], DOCS).repartition(3)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=default_pieces())


# --- 11
def test_chunks_are_segmented_and_decoded_as_by_the_library(library):
    own, r = pieces.load(default_pieces()), random.Random(4)
    some = [" ", "  ", "▁", "\t", "\n", "\0", "a", "b", "the", "ing", "é", "ሀ", "😀", "漢", "<s>", "</s>", "<unk>", "<0x41>", "�", "　", "​", "0", "12", ".", "\U0010ffff"]
    for _ in range(5000):
        text = "".join(r.choice(some) for _ in range(r.randint(0, 14)))
        ids = library.encode(text, add_eos=True)
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids)
    for _ in range(5000):  # ids that no text has: broken UTF-8, control and unknown pieces
        ids = [r.choice((0, 1, 2, r.randrange(3, 259), r.randrange(259, 32000), 259)) for _ in range(r.randint(0, 6))]
        assert own.decode(ids) == library.decode(ids)
    every = "".join(chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000)
    long = "x" * 50_000 + " " * 5_000 + "ab" * 20_000
    assert own.encode(every) == library.encode(every, add_eos=True) and own.encode(long) == library.encode(long, add_eos=True)


def of_library(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_eos=True)
        out.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return sorted(out, key=str)


def test_pieces_of_documents_equal_the_library(spark, library, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = pieces.digests(docs)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == of_library(library, docs.select("doc_id", "text").collect())
    assert sorted(map(tuple, pieces.digests(odd).collect()), key=str) == of_library(library, [r[:2] for r in ODD])
    assert pieces.digests(odd.where("doc_id < -1")).count() == 0


def test_pieces_keep_their_general_interface(spark, library):
    rows = [("a", "one two  two ▁ \t x"), ("b", None), (None, ""), ("a", "two")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "name string, body string, ids string")
    out = {(r["name"], r.decoded): r.ids for r in pieces.encoded(df, id_col="name", text_col="body").collect()}
    assert out == {(n, library.decode(library.encode(t or "", add_eos=True))): library.encode(t or "", add_eos=True) for n, t in rows}


def test_the_table_holds_the_commonest_chunks(spark, library):
    df = spark.createDataFrame([(k, f"the same words the same once{k} {'long' * 9} {'long' * 9} twice twice") for k in range(300)], "doc_id long, text string").repartition(3)
    path, counts = default_pieces(), {r.chunk: r.n for r in pieces.counted(df).collect()}
    assert counts == {" the": 600, " same": 600, " words": 300, " twice": 600}
    every = pieces.table(df, path)
    assert every == {c: library.encode(c[1:]) for c in counts}
    assert set(pieces.table(df, path, most=3)) == {" the", " same", " twice"} and pieces.table(df, path, most=2) == {} and pieces.table(df.limit(0), path) == {}
    known = pieces.Known(pieces.load(path), every, len, most=2)
    assert [known[c] for c in (" the", " a", " b", " c", " a")] == [1] * 5 and len(known.now) + len(known.before) <= 4 and len(known) == 4


def test_chunks_segmented_side_by_side_equal_single_ones(monkeypatch):
    own, r = pieces.load(default_pieces()), random.Random(6)
    some = [" ", "a", "b", "e", "the", "ing", "é", "è", "ou", "漢", "😀", "\n", ",", "0", "x" * 9]
    every = ["".join(r.choices(some, k=r.randint(1, 8))).replace("▁", " ") for _ in range(6000)] + [" ", "a", "😀", "z" * 70]
    want = [own.segment(c) for c in every]
    assert own.segment_all(every) == want and own.segment_all([]) == []
    texts = [*(" ".join(r.choices(every, k=20)) for _ in range(200)), None, ""]
    monkeypatch.setattr(pieces, "TOGETHER", 3000)
    merged = []
    monkeypatch.setattr(pieces.Pieces, "segment", lambda self, c, one=pieces.Pieces.segment: merged.append(c) or one(self, c))
    known = pieces.Known(own, {}, lambda ids: ids)
    assert [[k for ids in found for k in ids] + [own.end] for found in known.of(texts)] == [own.encode(t) for t in texts]
    merged.clear()
    list(pieces.Known(own, {}, lambda ids: ids).of(["one two three, and what are plain words here"]))
    assert not merged  # none of them by itself


# --- 12
def brute_whitening(vectors, most=32):
    x = np.floor(np.asarray(vectors, float) * 64).astype(int) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    apart = n * x - total
    v = apart.astype(float) / n
    cov = v.T @ v / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return n, [sum(int(a) ** 2 for a in r) for r in apart], v @ axes / np.sqrt(values), values / np.trace(cov)


def test_whitening_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, deviation, white, share = brute_whitening([r.embedding for r in table])
    rows = queries.op12_whitening(spark, SF).collect()
    assert len(rows) == n * min(32, len(table[0].embedding))
    at = {r.vec_id: k for k, r in enumerate(table)}
    sign = {}
    for r in rows:
        k, c = at[r.vec_id], r.component - 1
        assert (r.n, r.deviation) == (n, deviation[k]) and abs(r.explained / share[c] - 1) < 1e-9 and r.identity_error < 1e-9
        sign.setdefault(c, np.sign(r.whitened * white[k, c]))
        assert abs(r.whitened - sign[c] * white[k, c]) < 1e-8


def test_moments_merge_in_any_order_and_keep_sums_exact():
    rng = np.random.default_rng(2)
    rows = rng.integers(-50, 50, (1000, 5)) + 10**8
    parts = np.split(rows, [1, 1, 400, 990])
    whole = whitening.Moments()
    for p in parts[::-1]:
        whole = whole.merged(whitening.Moments.of(p))
    centred = rows - rows[0]
    assert whole.n == 1000 and whole.total == [sum(c) for c in rows.T.tolist()]
    assert np.allclose(whole.scatter / 1000, np.cov(centred.T, bias=True), rtol=1e-9, atol=1e-6)
    huge = np.array([[2**62, 5], [2**62, 6], [2**62 + 2, 7]], np.int64)
    assert whitening.Moments.of(huge).total == [3 * 2**62 + 2, 18]


def test_deviations_are_exact_at_the_ends_of_the_range():
    rows = np.array([[2**61, 0], [-(2**61), 3], [7, 9]], np.int64)
    w = whitening.Whitener(3, [7, 12], 1.0, np.ones(2), np.eye(2), np.ones(2, bool))
    apart = w.deviations(rows)
    assert [[int(v) for v in r] for r in apart] == [[3 * 2**61 - 7, -12], [-3 * 2**61 - 7, -3], [14, 15]]
    assert w.squares(apart) == [None, None, 14**2 + 15**2]
    near = np.array([[math.isqrt(2**63 - 1), 0], [math.isqrt(2**63 - 1) + 1, 0]], np.int64)
    assert w.squares(near) == [math.isqrt(2**63 - 1) ** 2, None]


def test_whitening_of_odd_vectors(spark):
    fine = [(k, [float(k % 7), float(k % 5)]) for k in range(40)] + [(3, [3.0, 3.0]), (None, [1.0, 2.0])]
    bad = [(90, None), (91, []), (92, [1.0, None]), (93, [float("nan"), 1.0]), (94, [1.0, float("inf")]), (95, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(fine + bad, "vec_id long, embedding array<float>").withColumn("n", F.lit("clash")).repartition(5)
    rows = whitening.components(df).collect()
    n, deviation, white, share = brute_whitening([v for _, v in fine])
    assert len(rows) == 2 * len(fine) and {r.vec_id for r in rows} == {k for k, _ in fine} and {r.n for r in rows} == {n}
    assert collections.Counter(r.deviation for r in rows if r.component == 1) == collections.Counter(deviation)
    assert np.allclose(sorted(abs(r.whitened) for r in rows if r.component == 2), sorted(abs(white[:, 1])))
    equal = whitening.components(df.where("vec_id = 3")).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in equal] == [(0, None, 0.0, None)] * 4
    flat = whitening.components(spark.createDataFrame([(k, [float(k), 2.0]) for k in range(9)], "vec_id long, embedding array<double>")).collect()
    assert {r.whitened is None for r in flat if r.component == 2} == {True} and all(r.identity_error < 1e-9 for r in flat)
    assert whitening.components(df.where("vec_id > 89 and vec_id < 95")).count() == 0 and whitening.components(df.limit(0)).count() == 0
    far = whitening.components(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(far) == 4 and {r.deviation for r in far} == {None}


# --- 13
def test_audit_equals_sql(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        same(queries.op13_source_divergence(spark, sf), queries.ORACLE_SQL["op13_source_divergence"], duck(sf))


def brute_audit(rows, least, most):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans(divergence._UPPER, divergence._LOWER)
    docs = [(lang or "", source or "", term.findall((text or "").translate(low))) for text, lang, source in rows]
    held, n = collections.Counter(), collections.Counter()
    for lang, source, terms in docs:
        held.update((lang, t) for t in set(terms))
        n.update((lang, source, t) for t in terms)
    kept = collections.defaultdict(list)
    for (lang, t), k in held.items():
        if k >= least:
            kept[lang].append(t)
    groups = sorted({d[:2] for d in docs})
    out = []

    def share(count, total, lang):
        return 1 + 10**9 * (count + 5) // (total + 5 * len(kept[lang]))

    sums = {(g, s): sum(n[g, s, t] for t in kept[g]) for g, s in groups}
    for lang, source in groups:
        p = {t: share(n[lang, source, t], sums[lang, source], lang) for t in kept[lang]}
        others = [s for g, s in groups if g == lang and s != source]
        whole = sum(v for (g, _), v in sums.items() if g == lang)
        found = [(-sum(abs(p[t] - share(n[lang, s, t], sums[lang, s], lang)) for t in p), s.encode(), "pair") for s in others]
        q = {t: share(sum(n[lang, s, t] for g, s in groups if g == lang), whole, lang) for t in p}
        terms = [(q[t] - p[t], t.encode(), "term") for t in p if n[lang, source, t] and p[t] > q[t]]
        for part, limit in ((found, None), (terms, most)):
            out += [(lang, source, kind, item.decode(), -v, k) for k, (v, item, kind) in enumerate(sorted(part)[:limit], 1)]
    return sorted(out)


def test_audit_of_odd_rows(spark, odd):
    r = random.Random(7)
    words = ["a", "B", "ß", "É", "é", "漢字", "😀x", "it's", "x1y", "\u0085q", "Zz", "\x7f", "İ"]
    rows = [(r.choice((" ", ",", "0", "[")).join(r.choice(words) for _ in range(r.randint(0, 9))), r.choice(("en", None, "", "EN")), r.choice(("s", "t", None, "u", "é"))) for _ in range(250)]
    rows += [(None, "en", "none"), ("", "alone", "one"), ("b b b " * 4000, "en", "s")] + rows[:20]
    df = spark.createDataFrame([(*x, 1, "clash") for x in rows], "text string, lang string, source string, n long, term string").repartition(4)
    out = divergence.audited(df, least_docs=5, most_terms=3)
    assert sorted(map(tuple, out.collect())) == brute_audit(rows, 5, 3)
    found = divergence.audited(odd).collect()
    assert sorted(map(tuple, found)) == brute_audit([(x[1], x[2], x[3]) for x in ODD], 30, 50) and {x.value for x in found} == {0}
    assert divergence.audited(odd.where("doc_id < -1")).count() == 0
