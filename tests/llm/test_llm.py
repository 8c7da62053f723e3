"""The training-data operators against brute force, exact round trips and held-out accuracy, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quiremill.llm import ann, bitpack, bpe, exact_dedup, langid, near_dedup, packing, pii, pii_lines, queries, suffix_dedup, toxicity
from quiremill.llm._common import default_vocabulary
from tests.oracle import duck, same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, salt string, kept string"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30000))
ODD = [(0, None, None, None, None), (1, "", "en", "s", 0), (2, "   \n", "en", None, 4), (3, "Same text here", "en", "s", 14), (4, "Same  text\there", "en", "s", 15), (5, "Same text here", None, "s", None), (6, LONG, "de", "t", len(LONG)), (7, LONG + " end", "de", "t", 1), (8, "é́ Σ 😀 <|endoftext|> a@b.co", "fr", "", 3), (8, "é́ Σ 😀 <|endoftext|> a@b.co", "fr", "", 3), (None, "no id", "en", "s", 5), (9, "x" * 100_000, "xx", "u", 100_000), (10, "\x1c\x00\x85", "en", "s", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in ODD], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("doc_id < -1")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


# --- 1
def test_nearest_has_recall_and_exact_scores(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = queries.op1_hash_prefix_forest(spark, SF).collect()
    table = e.toPandas()
    v = np.stack(table.embedding).astype(float)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    found = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.vec_id, r.score))
    ids = table.vec_id.to_numpy()
    hits = 0
    for q, got in found.items():
        s = unit @ unit[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -s))[:5]]
        hits += len(set(best) & {g[0] for g in got})
        assert [g[1] for g in got] == sorted((g[1] for g in got), reverse=True)
        assert all(abs(s[ids == g[0]][0] - g[1]) < 1e-12 for g in got)
    assert set(found) == {i for i in ids if i % 50 == 0} and hits >= 0.9 * 5 * len(found)


def test_nearest_on_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [1.0, float("nan")]), (7, [0.0, 1.0]), (8, [1.0, 0.0, 0.0]), (50, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (9, [float("inf"), 1.0]), (10, []), (11, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    out = [tuple(r) for r in ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in out] == [(0, 1, 1), (0, 2, 2), (0, 3, 7), (0, 4, 11), (50, 1, 8)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_in_blocks_of_queries(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked, options = e.where("vec_id % 50 = 0"), {"shard_rows": 64}
    whole = sorted(tuple(r) for r in ann.nearest(e, asked, **options).collect())
    cut = ann.nearest(e, asked, block_queries=2, **options)
    assert sorted(tuple(r) for r in cut.collect()) == whole and len(whole) == 5 * asked.count()


def test_nearest_with_repeated_rows(spark):
    rows = [(50, [1.0, 0.0])] + [(k, [1.0, 0.01 * k]) for k in range(1, 7) for _ in range(8)]
    rows += [(7, [1.0, 0.001 + 1e-5 * j]) for j in range(3500)]  # one id, many near rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = [tuple(r)[:3] for r in ann.nearest(df, df.where("vec_id = 50")).orderBy("rank").collect()]
    assert out == [(50, 1, 7), (50, 2, 1), (50, 3, 2), (50, 4, 3), (50, 5, 4)]


# --- 2
def check_packing(rows, ids_of):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids_of)
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            part = ids_of[d][r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids_of[d]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids_of[d])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(by_sequence)


def test_packing_places_every_id_once(docs, library):
    table = docs.toPandas()
    ids_of = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in zip(table.doc_id, table.text, strict=True)}
    sequences = check_packing(packing.packed(docs).collect(), ids_of)
    assert sequences <= 1.02 * sum(map(len, ids_of.values())) / 2048 + 1


def test_packing_odd_rows(odd, empty, library):
    one = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids_of = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in one.collect()}
    check_packing(packing.packed(one).collect(), ids_of)
    assert packing.packed(odd).agg(F.sum("length")).first()[0] == packing.packed(odd).dropDuplicates(["doc_id", "start", "sequence_id", "offset"]).agg(F.sum("length")).first()[0]
    assert packing.packed(empty).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 50), max_size=16))
def test_plans_hold_the_histogram(histogram):
    plan = packing.plan(histogram, 16)
    held = collections.Counter()
    for sizes, counts, times in plan:
        assert (sizes * counts).sum() <= 16
        for s, n in zip(sizes.tolist(), counts.tolist(), strict=True):
            held[s] += n * times
    assert held == collections.Counter(histogram)


# --- 3
def test_phrases_are_those_of_a_plain_parse():
    r = random.Random(1)
    passages = {"a": ["Hello world, helium", "the held world"], "b": ["Monde!", "bonjour", "le monde"]}
    model = langid.Model(passages)
    learned = {"a": " hello world helium the held world ", "b": " monde bonjour le monde "}
    texts = ["".join(r.choice("helowrdiumnbjxé H,.3") for _ in range(r.choice([0, 1, 5, 300, 1000]))) for _ in range(200)] + list(learned.values())
    codes, at, has = langid.letters_of(texts)
    got = model.parsed(codes, at)
    for k, t in enumerate(texts):
        plain = " " + re.sub(r"[^a-zé]+", " ", t.lower()).strip(" ")
        whole = "".join(map(chr, codes[at[k] : at[k + 1]]))
        assert whole.rstrip(" ") == plain.rstrip(" ") and has[k] == bool(plain.strip())
        for lang, text in enumerate(learned.values()):
            n = 0
            for first in range(0, len(whole), langid.STRETCH):
                part, p = whole[first : first + langid.STRETCH], 0
                while p < len(part):
                    end = p + 1
                    while end <= len(part) and part[p:end] in text:
                        end += 1
                    p, n = max(p + 1, end - 1), n + 1
            assert got[k, lang] == n, t


def test_language_on_held_out_rows(spark, docs):
    rows = {r.doc_id: r for r in queries.op3_language_id(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert set(rows) == set(truth) and all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    held = [d for d, r in rows.items() if r.held_out]
    assert sum(rows[d].lang_pred == truth[d] for d in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in rows.values())


def test_language_of_odd_rows(docs, odd, empty):
    model = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(odd, model).collect()}
    assert all(got[d] == ("und", 0.0) for d in (0, 1, 2, 10)) and got[3][0] in model.languages
    assert langid.predicted(odd).count() == len(ODD) and langid.predicted(empty).count() == 0
    assert set(langid.identified(odd, langid.fit(empty)).select("lang_pred").distinct().collect()) == {("und",)}
    assert langid.accepted(odd, model).columns == odd.columns


def test_a_language_with_hardly_any_letters_takes_nothing_over(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1, "12345 67", "xx"), (-2, "ab", "yy"), (-3, "the und", "zz"), (-4, "\u0301\u0301", "mm")], docs.schema)
    every = docs.unionByName(more)
    model = langid.fit(every.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    assert set(model.languages) <= {"de", "en", "es", "fr", "yy", "zz"} and len(set(model.bits)) == 1
    rows = langid.predicted(every).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) > 0.99 * len(rows)
    known = langid.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    assert langid.accepted(docs, model).count() >= langid.accepted(docs, known).count() - 1


def test_every_language_is_learned(spark, odd, empty):
    r, rows = random.Random(2), []
    for n in range(30):
        words = ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(12)]
        rows += [(100 * n + k, " ".join(r.choices(words, k=40)), f"l{n:02}") for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x.lang_pred for x in langid.identified(df, langid.fit(df)).collect()}
    assert got == {d: lang for d, _, lang in rows}
    assert langid.accepted(odd, langid.fit(empty)).count() == len(ODD)  # nothing learned, nothing rejected


def test_languages_of_thousands_of_letters_are_learned_and_accepted(spark):
    r = random.Random(4)
    han = ["".join(chr(r.randint(0x4E00, 0x4E00 + 4000)) for _ in range(2)) for _ in range(5000)]
    latin = ["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(500)]
    rows = [(k, "".join(r.choices(han, k=200)), "zh") for k in range(60)] + [(100 + k, " ".join(r.choices(latin, k=80)), "xx") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fresh = spark.createDataFrame([(k + 1000, t, lang) for k, t, lang in [(0, "".join(r.choices(han, k=150)), "zh"), (1, " ".join(r.choices(latin, k=60)), "xx")]] + [(2000, "ᚠᚢᚦᚨᚱᚲᚷᚹᚺᚾᛁᛃᛇᛈᛉᛊᛏᛒᛖᛗᛚᛜᛞᛟ" * 4, "zh"), (2001, "1234 5678", "xx")], df.schema)
    model = langid.fit(df)
    assert {x.doc_id: x.lang_pred for x in langid.identified(fresh, model).collect()} | {2000: ""} == {1000: "zh", 1001: "xx", 2000: "", 2001: "und"}
    assert {x.doc_id for x in langid.accepted(fresh, model).collect()} == {1000, 1001}
    assert langid.accepted(df, model).count() == len(rows)


# --- 4
_CHARS = "abcdefghijklmnopqrstuvwxyz'.,!-0123456789²½ⅧΣσςİIıſKﬁé日本한😀👍🏽́̈   \x1c\x85\t\n<|>/ABC"


def test_bpe_is_the_librarys(library, docs):
    mine = bpe.load(default_vocabulary())
    r = random.Random(5)
    texts = ["".join(r.choice(_CHARS) for _ in range(r.randint(0, 30))) + r.choice(("", "", "<|endoftext|>x")) for _ in range(4000)]
    texts += [x[0] * r.randint(1, 40) for x in "aeno=!.😀"] + [row.text for row in docs.limit(40).collect()]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == want, t
        assert mine.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_digests(odd, empty, library):
    for r in bpe.digests(odd).collect():
        text = next(x[1] for x in ODD if x[0] == r.doc_id) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert bpe.digests(empty).count() == 0 and bpe.encoded(odd).count() == len(ODD)


def test_ids_of_every_code_point_are_the_librarys(library):
    own, of_files = bpe.load(default_vocabulary()), bitpack.library_encoder(default_vocabulary())
    texts = [f"a{chr(c)}b {chr(c)}\u0301 Q{chr(c)}" for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and not 0x30000 < c < 0xE0000 and not 0xF0100 < c]
    for a in range(0, len(texts), 20000):
        want = [x.ids for x in library.encode_batch(texts[a : a + 20000], add_special_tokens=False)]
        assert [own.encode(t) for t in texts[a : a + 20000]] == want
        assert [np.frombuffer(of_files(t), "<u4").tolist() for t in texts[a : a + 20000 : 7]] == want[::7]


# --- 5
def test_exact_dedup_is_sql(spark):
    same(queries.op5_exact_dedup(spark, SF), queries.ORACLE_SQL["op5_exact_dedup"], duck(SF))


def test_exact_dedup_of_odd_rows(odd, empty):
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.groups(odd).collect()}
    assert got[0] == got[1] == got[2] == (2, 3) and got[3] == got[4] == got[5] == (4, 3) and got[8] == (8, 2) and got[None] == (None, 1)
    assert exact_dedup.groups(empty).count() == 0
    assert sorted(str(r.doc_id) for r in exact_dedup.deduplicated(odd).collect()) == sorted(["2", "4", "6", "7", "8", "None", "9", "10"])


def test_exact_dedup_compares_whole_texts(spark, odd):
    rows = [(k, f"{k % 13} text{' ' * (k % 5)} {chr(97 + k % 3)}") for k in range(300)] + [(1, "alpha"), (1, "beta"), (2, "be  ta"), (9, "twice"), (9, "twice"), (None, "z"), (None, "z"), (None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    weak = lambda norm: F.length(norm).cast("string")
    fields = ("doc_id", "keep_id", "group_size", "kept")
    key = lambda r: tuple(str(r[f]) for f in fields)
    assert sorted(map(key, exact_dedup.groups(df, digest=weak).collect())) == sorted(map(key, exact_dedup.groups(df).collect()))
    for digest in (weak, exact_dedup.sha256):
        kept = exact_dedup.deduplicated(df, digest=digest).collect()
        norms = [re.sub(r"\s", "", r.text) for r in kept]
        assert sorted(norms) == sorted({re.sub(r"\s", "", t) for _, t in rows})
        assert (2, "be  ta") in kept and (1, "beta") not in kept


# --- 6
def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(3)
    rows = [(k, " ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(30)) + (" awful thing" if k % 7 == 0 else "")) for k in range(700)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 7 == 0)) for k in range(700)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.classified(d, lab).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in set(held)) for k in got)
    assert sum(got[k].predicted == (k % 7 == 0) for k in held) >= 0.97 * len(held) and all((x.score >= 0.5) == bool(x.predicted) for x in got.values())


def test_ftrl_is_the_plain_update():
    r = np.random.default_rng(5)
    rows = [np.append(np.sort(r.choice(40, 6, replace=False)), 40) for _ in range(60)]
    y, weight = r.integers(0, 2, 60).astype(float), r.random(60) + 0.5
    alpha, beta, l1, l2 = 0.7, 1.0, 0.3, 0.5
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def w(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(3):
        for k in order.permutation(60):
            now = {i: w(i) for i in rows[k].tolist()}
            g = (1 / (1 + np.exp(-sum(now.values()))) - y[k]) * weight[k]
            for i, wi in now.items():
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * wi
                n[i] += g * g
    got = toxicity.ftrl(rows, y, weight, 41, epochs=3, alpha=alpha, beta=beta, l1=l1, l2=l2)
    assert np.allclose(got, [w(i) for i in range(41)], atol=1e-12) and (got == 0).any()


def test_toxicity_scores_are_the_sums_of_weights(docs):
    import xxhash

    lab = docs.sparkSession.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, lab)
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    mix, whole = 0x9E3779B97F4A7C15, (1 << 64) - 1
    for x in toxicity.scored(docs, model).join(docs, "doc_id").select("text", "score").collect():
        words = re.findall(r"[^\W\d_]+", x.text.lower())
        full, head = [xxhash.xxh64_intdigest(v, 1) for v in words], [xxhash.xxh64_intdigest(v[:5], 2) for v in words]
        pairs = [((a * mix + seed) & whole) ^ (b >> 7) for gap, seed in ((1, 3), (2, 5)) for a, b in zip(full, full[gap:], strict=False)]
        total = model.intercept + sum(weight.get((h * mix & whole) >> 32, 0.0) for h in {(h * mix & whole) >> 32: h for h in full + head + pairs}.values())
        assert abs(x.score - 1 / (1 + np.exp(-np.clip(total, -35, 35)))) < 1e-9


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 4 / 6), ("sf0.1", 0.8)])
def test_toxicity_on_held_out_rows(spark, sf, least):
    # labels hold noise: 2 of the 6 toxic rows that sf0.01 holds out, and 6 of the 97 of sf0.1, have no word in common with other toxic ones
    rows = queries.op6_toxicity(spark, f"/root/testdata/{sf}").join(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= least * len(toxic) - 1e-9
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.005 * len(rows)


def test_toxicity_of_odd_rows(spark, odd, empty):
    lab = spark.createDataFrame([(3, 1), (3, 0), (6, 0), (7, None), (None, 1), (99, 0)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    assert toxicity.classified(odd, lab).where("score between 0 and 1").count() == len(ODD)
    assert toxicity.classified(odd, lab.limit(0)).where("predicted = 0").count() == len(ODD) and toxicity.classified(empty, lab).count() == 0


# --- 7
def brute_components(texts, k=4, percent=80):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    shared = collections.Counter((a, b) for own in where.values() for n, a in enumerate(own) for b in own[:n])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_near_dedup_is_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    want = brute_components(dict(zip(rows.doc_id, rows.text, strict=True)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_near_dedup(spark, "/root/testdata/sf0.01").collect()} == want


def test_near_dedup_finds_links_past_a_stars_centre(spark):
    # the least id is the worst copy: it is linked with few, and the others only with one another; tiny sets and chains too
    base = [f"b{k}" for k in range(60)]
    texts = {0: " ".join([*base[:42], *(f"z{k}" for k in range(18))])}
    texts |= {k: " ".join([*base[:k], f"edit{k}", *base[k + 1 :]]) for k in range(1, 40)}
    texts |= {100: "a b c d e f g h", 101: "a b c d e f g", 102: "a b c d e f", 103: "a b", 104: "A  b", 105: "a", 106: "  "}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.linked(df, block=8).collect()} == brute_components(texts)


def test_near_dedup_of_odd_rows(odd, empty):
    got = {r.doc_id: (r.component_id, r.n_shingles > 0, r.kept) for r in near_dedup.linked(odd).collect()}
    assert got[0] == (0, False, True) and got[2] == (2, False, True) and got[5] == (3, True, False) and got[7] == (6, True, False) and got[None] == (None, True, True)
    assert near_dedup.linked(odd).count() == len(ODD) and near_dedup.linked(empty).count() == 0
    assert near_dedup.deduplicated(odd).columns == odd.columns


def test_near_dedup_of_ids_with_several_texts(spark):
    texts = {c: " ".join(f"{c}{k}" for k in range(30)) for c in "abcd"}
    rows = [(5, texts["a"]), (5, texts["b"]), (7, texts["a"]), (1, texts["b"]), (9, texts["c"]), (9, texts["c"]), (8, texts["d"] + " more"), (2, texts["d"]), (3, ""), (None, texts["a"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.linked(df).collect())
    assert got == sorted([("5", "1", False), ("5", "1", False), ("7", "1", False), ("1", "1", True), ("9", "9", True), ("9", "9", True), ("8", "2", False), ("2", "2", True), ("3", "3", True), ("None", "None", True)])
    clash = near_dedup.deduplicated(df.withColumn("__row", F.lit("mine")).withColumn("row", F.lit(1)))
    assert clash.columns == ["doc_id", "text", "__row", "row"] and {(r["__row"], r["row"]) for r in clash.collect()} == {("mine", 1)}
    kept = [r.text for r in near_dedup.deduplicated(df).collect()]
    assert sorted(kept) == sorted([texts["a"], texts["b"], texts["c"], texts["d"], ""])  # a text of each group, whatever its id


# --- 8
def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, *m.span()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b1", "@", ".", "1", "25", "255", "0", " ", "-", "+", "(", ")", "x@y.z", "\n", "é", "4111111111111111", "+1 234 567"]), max_size=24))
def test_base_spans_are_the_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pii_query_is_the_plain_patterns_and_more(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    rows = queries.op8_pii(spark, f"/root/testdata/{sf}").collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    order = ("email", "ip", "card", "phone")
    for r in rows:
        text = texts[r.doc_id]
        base = [f"{k}:{a}:{z}" for k, a, z in plain_spans(text)]
        every = r.spans.split(",") if r.spans else []
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b.startswith(f"{k}:") for b in base) for k in order)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(every)
        # what the field adds holds as many digits as its kind asks for, and an address its sign or words for it
        for kind, start, end in (e.split(":") for e in set(every) - set(base)):
            part = text[int(start) : int(end)]
            digits = sum(c in "0123456789" for c in part)
            assert kind in order and (kind == "email" and ("@" in part or " at " in part.lower() or "(at)" in part.lower()) or kind == "ip" and digits >= 4 or kind == "card" and 13 <= digits <= 19 or kind == "phone" and 7 <= digits <= 15), part


def test_field_adds_what_patterns_miss():
    field = pii.fit()
    lines = pii_lines.by_rule(200, seed=77)
    both = pii.all_spans([t for t, _ in lines], field)
    assert all(set(own) <= set(every) for own, every in both)
    hit = sum(len(set(s) & set(every)) for (_, s), (_, every) in zip(lines, both, strict=True))
    wrong = sum(len(set(every) - set(own) - set(s)) for (_, s), (own, every) in zip(lines, both, strict=True))
    assert hit >= 0.9 * sum(len(s) for _, s in lines) and wrong <= 0.03 * hit
    # exact decoding: the best of all paths of a short window
    import itertools

    symbols = np.array([[t[0] for t in pii._listed("call (555) 1")]])
    score = field.scores(symbols)[0]
    best = max(itertools.product(range(9), repeat=symbols.shape[1]), key=lambda y: field.move[0, y[0]] + sum(score[t, y[t]] for t in range(len(y))) + sum(field.move[a, b] for a, b in itertools.pairwise(y)) + field.move[y[-1], 0])
    assert tuple(field.decode(symbols, np.array([symbols.shape[1]]))[0]) == best


def test_field_loses_nothing_in_long_dense_texts():
    field, r, text, want = pii.fit(), random.Random(6), "", []
    for _ in range(1500):
        text += "call " + "".join(r.choice("aeioubcdfg") for _ in range(5)).title() + ": "
        phone = f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}"
        want.append(("phone", len(text), len(text) + len(phone)))
        text += phone + ",\n"
    assert pii.all_spans([text, "call (555) 123-4567"], field)[0][1] == want
    # scores by blocks of tokens are those of the whole
    symbols = np.array([[x[0] for x in pii._listed(text[:30000])]])
    best, score = None, field.scores(symbols)[0]
    for t in range(symbols.shape[1]):
        best = score[t] + (field.move[0] if best is None else (best[:, None] + field.move).max(axis=0))
    y = field.decode(symbols, np.array([symbols.shape[1]]))[0]
    path = field.move[0, y[0]] + score[np.arange(len(y)), y].sum() + field.move[y[:-1], y[1:]].sum() + field.move[y[-1], 0]
    assert abs(path - (best + field.move[:, 0]).max()) < 1e-6


def whole_text_spans(text, field):
    """The field's spans where all tokens of a text go through one Viterbi."""
    found, out, t = pii._listed(text), [], 0
    path = field.decode(np.array([[x[0] for x in found]]), np.array([len(found)]))[0].tolist() if found else []
    while t < len(path):
        u = t + 1
        if path[t]:
            while u < len(path) and path[u] == path[t] + path[t] % 2:
                u += 1
            out.append((pii._LABELS[path[t]][2:], found[t][1], found[u - 1][2]))
        t = u
    return out


def test_field_decodes_whole_texts(docs):
    field = pii.fit()
    texts = [x for x, _ in pii_lines.by_rule(3000, seed=9)] + [r.text or "" for r in docs.select("text").collect()] + ["", " ", "x" * 5000, "1 " * 3000, "@ at dot " * 800]
    assert pii.labelled(texts, field) == [whole_text_spans(t, field) for t in texts]
    # weights that are sure of little
    r = np.random.default_rng(3)
    for size in (0.3, 2.0):
        wild = pii.Field(r.normal(0, size, field.emit.shape), r.normal(0, size, field.move.shape) + pii._legal())
        wild.emit[2, :, 0] += 2 * size
        assert pii.labelled(texts[:300], wild) == [whole_text_spans(t, wild) for t in texts[:300]]


def test_field_finds_addresses_without_any_digit_or_sign():
    field, r = pii.fit(), random.Random(5)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvz") for _ in range(r.randint(3, 9)))
    lines = [f"mail {word()} at {word()}.{r.choice(('com', 'org', 'net', 'de'))}" for _ in range(500)]
    assert [every for _, every in pii.all_spans(lines, field)] == [[("email", 5, len(x))] for x in lines]
    for name in ("a.very.long.personal.mail.box.name.of.jane.q.public.springfield", "x" * 60):
        text = f"{name} at example dot org"
        assert pii.all_spans([text], field)[0][1] == [("email", 0, len(text))]


def test_field_on_lines_by_hand_that_it_has_not_seen():
    lines, wrong, hit, total = pii_lines.by_hand(), 0, 0, 0
    field = pii.fit(hand=tuple((x, tuple(s)) for k, (x, s) in enumerate(lines) if k % 3))
    for (_, want), (_, every) in zip(lines[::3], pii.all_spans([x for x, _ in lines[::3]], field), strict=True):
        hit, total, wrong = hit + len(set(want) & set(every)), total + len(want), wrong + len(set(every) - set(want))
    assert hit >= 0.75 * total and wrong == 0


def test_pii_of_odd_rows(spark, odd, empty):
    got = {r.doc_id: r for r in pii.found(odd).collect()}
    assert got[8].n_email == 1 and got[8].spans.startswith("email:") and got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.found(empty).count() == 0
    clean = {r.doc_id: r for r in pii.redacted(odd).collect()}
    assert clean[8].text.endswith("[EMAIL]") and clean[8].n_chars == len(clean[8].text) and clean[0].text is None and clean[6].text == LONG
    assert pii.redact("a b c d", [("ip", 2, 5), ("card", 4, 7)]) == "a [IP]"


# --- 9
def test_repeated_passages(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    shared, short = [word() for _ in range(70)], [word() for _ in range(49)]
    texts = {k: [word() for _ in range(200)] for k in range(12)}
    for k in (1, 5, 9):
        texts[k][100:100] = shared
    for k in (2, 6):
        texts[k][20:20] = short
    line = [word() for _ in range(60)]
    texts[3] += line + ["x"] + line  # only within one document
    texts[20] = list(texts[4])
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string").repartition(4)
    got = sorted(tuple(x) for x in suffix_dedup.repeated(df).collect())
    assert got == sorted([*((k, 100, 170, 70) for k in (1, 5, 9)), (4, 0, 200, 200), (20, 0, 200, 200)])


def test_repeated_passages_that_end_in_a_hot_phrase(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    many = [word() for _ in range(5000)]
    least = int(suffix_dedup.runs(suffix_dedup.Words().of(" ".join(many)), 20).argmin())
    phrase, texts, want = many[least : least + 20], {}, []  # a gram that is nearly always the only minimiser around
    for k in range(0, 80, 2):  # rare text before the phrase, shared by two documents; longer ones have a left edge to lose
        rare = [word() for _ in range(30 + k % 3 * 10)]
        for d in (k, k + 1):
            texts[d] = [word() for _ in range(60)] + rare + phrase + [word() for _ in range(60)]
            want.append((d, 60, 80 + len(rare), 20 + len(rare)))
    for d in range(80, 200):
        texts[d] = [word() for _ in range(60)] + phrase + [word() for _ in range(60)]
    line = [word() for _ in range(50)]
    for k in range(200, 260, 2):  # a hot line behind rare text
        rare = [word() for _ in range(25)]
        for d in (k, k + 1):
            texts[d] = [word() for _ in range(40)] + rare + line
            want.append((d, 40, 115, 75))
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string").repartition(4)
    assert sorted(tuple(x) for x in suffix_dedup.repeated(df).collect()) == want


def brute_passages(texts, least=50):
    """Maximal runs of words covered by windows of ``least`` words that two documents have."""
    where, words = collections.defaultdict(set), {d: t.lower().split() for d, t in texts.items()}
    for d, w in words.items():
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add(d)
    out = []
    for d, w in words.items():
        begin = end = None
        for k in range(len(w) - least + 1):
            if len(where[tuple(w[k : k + least])]) > 1:
                if end is None or k > end:
                    if end is not None:
                        out.append((d, begin, end, end - begin))
                    begin = k
                end = k + least
        if end is not None:
            out.append((d, begin, end, end - begin))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_passages_are_brute_force(spark, seed):
    # a few phrases in all orders, lines repeated within and across documents: many equal keys, ranges of one document
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    phrases = [[word() for _ in range(r.randint(3, 30))] for _ in range(10)]
    texts = {}
    for d in range(120):
        w = []
        while len(w) < 150:
            w += r.choice(phrases) if r.random() < 0.7 else [word() for _ in range(r.randint(1, 20))]
        texts[d] = " ".join(w)
    texts[500] = " ".join(phrases[0] * 400)  # a document that is one line over and over
    texts[501] = " ".join(phrases[0] * 3 + phrases[1])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    assert sorted(tuple(x) for x in suffix_dedup.repeated(df, range_rows=100).collect()) == brute_passages(texts)  # many ranges


def test_repeated_passages_of_odd_rows(odd, empty):
    got = {r.doc_id: (r.start_word, r.end_word) for r in suffix_dedup.repeated(odd).collect()}
    assert got == {6: (0, 30000), 7: (0, 30000)} and suffix_dedup.repeated(empty).count() == 0


# --- 10
@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=8))
def test_shards_round_trip(bits, documents):
    arrays = [np.array(d, np.uint64) % (1 << bits) for d in documents]
    arrays = [a.astype(np.uint32) for a in arrays]
    s = bitpack.Shard(bitpack.shard([None, *range(len(arrays) - 1)] if arrays else [], arrays, bits, block=16))
    assert all((s.document(k) == a).all() for k, a in enumerate(arrays))
    flat = np.concatenate([np.empty(0, np.uint32), *arrays])
    assert all((s.ids(a, z) == flat[a:z]).all() for a in range(0, len(flat), 7) for z in (a, a + 3, len(flat)) if z <= len(flat))


def test_token_files(docs, odd, empty, library):
    for df in (docs, odd):
        at = 0
        rows = sorted(bitpack.round_trip(df, ids_per_shard=5000).collect(), key=lambda r: r.start)
        texts = collections.defaultdict(list)
        for r in df.collect():
            texts[r.doc_id].append(r.text or "")
        assert [r.doc_id for r in rows] == sorted([r.doc_id for r in rows], key=lambda d: -1 if d is None else d) and len(rows) == df.count()
        for r in rows:
            ids = [*library.encode(texts[r.doc_id][0], add_special_tokens=False).ids, 1]
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
    assert bitpack.round_trip(empty).count() == 0


# --- pipeline
def test_pipeline(spark, docs, library):
    out = corpus_pipeline.run(spark, SF)
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SF)
        assert stage.columns == docs.columns
    kept = {r.doc_id: r.text for r in stage.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute_components({d: t for d, t in texts.items() if re.search(r"[^\W\d_]", t or "")}, k=5)
    assert set(kept) <= {d for d, (_, c) in want.items()} and len({want[d][1] for d in kept}) == len(kept) == len({c for _, c in want.values()})
    ids_of = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in kept.items()}
    check_packing(out.collect(), ids_of)


def test_pipeline_keeps_one_row_of_repeated_ones(spark):
    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words[:59], "other"])
    rows = [(1, "a b c", "x")] * 5 + [(1, "another text", "x"), (2, "abc", "x"), (None, "null a", "x"), (None, "nulla", "x"), (3, "plain", "x"), (None, " plain", "x"), (4, " ".join(words), "x"), (None, near, "x"), (5, "alone", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    exact = corpus_pipeline.exact(spark, df, SF)
    key = lambda r: (str(r[0]), r[1])
    want = [(1, "a b c", "x"), (1, "another text", "x"), (None, "null a", "x"), (None, " plain", "x"), (4, " ".join(words), "x"), (None, near, "x"), (5, "alone", "x")]
    assert exact.columns == df.columns and sorted(map(tuple, exact.collect()), key=key) == sorted(want, key=key)
    # near copies: rows with repeated and null ids take part, one row each
    left = corpus_pipeline.near(spark, df.where("doc_id is null or doc_id in (1, 4)"), SF)
    want = [(1, "a b c", "x"), (1, "another text", "x"), (None, "null a", "x"), (None, "nulla", "x"), (None, " plain", "x"), (4, " ".join(words), "x")]
    assert left.columns == df.columns and sorted(map(tuple, left.collect()), key=key) == sorted(want, key=key)
