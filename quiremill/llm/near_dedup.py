"""Near duplicates by one-permutation MinHash, banded buckets and star-shaped candidate edges.

A document's set holds its distinct shingles (runs of ``words`` words; a shorter text is one shingle).
Two documents are linked when ``100 * shared >= percent * all``; components of links are the answer.

1. One scan hashes each text's shingles once. The top bits of a hash choose one of ``bins`` bins, the
   least hash in each is kept, and an empty bin borrows from a bin picked by a hash of (bin, attempt)
   until that is not empty (optimal densification). ``bins / rows`` bands of ``rows`` bins make keys.
   At a similarity of 0.8, 32 bands of 4 bins miss a pair with probability (1 - 0.8**4)**32 < 1e-7.
2. Documents with the same set are one class from here on, so groups of copies cost one row.
3. Each bucket of two or more classes is a star: all members against its least class. Stars' edges
   are confirmed on the full sets, which are read again for the classes in edges alone.
4. A star can miss a link between two members that are not linked to its centre. So every cluster (classes
   that stars connect, linked or not) which still holds more than one component is looked at again: members
   outside its largest component ask members of other components, by counting shared shingles through an index.
   Sets that are linked are nearly of one size, so a cluster is cut into classes of size, a factor apart that a link
   cannot bridge twice, and an asker goes to its own class and the two beside it. Members and askers of a class are dealt
   over blocks of bounded size, and each block of askers meets each block of members in a task of its own. This finds
   each link there is, and writes no more of them than it takes to join what they join.
5. Components come from contracting links towards smaller ids and then halving paths, as joins;
   nothing is collected to the driver.

All joins run between tables in the shared folder, so that adaptive execution can split hot keys.

Defined results: null and empty texts and texts of white space have no shingles and are components
of their own; so are rows with null id, whose component is null; equal rows and ties go to the
smallest id; rows with one id are one document, linked by whatever any of its texts is linked by, while ``n_shingles`` is
each row's own; ``deduplicated`` takes them for documents of their own; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.llm._common import dropped, sliced, staged
from quiremill.llm.words import Words, mixed, runs

BINS, ROWS = 128, 4


def signature(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Densified one-permutation MinHash of sorted distinct hashes (at least one)."""
    width = np.uint64(64 - (bins.bit_length() - 1))
    first = np.searchsorted(shingles, np.arange(bins, dtype=np.uint64) << width)
    own = np.minimum(first, len(shingles) - 1)
    full = (first < len(shingles)) & ((shingles[own] >> width) == np.arange(bins, dtype=np.uint64))
    out = shingles[own].copy()
    empty = np.flatnonzero(~full)
    attempt = 0
    while len(empty):
        attempt += 1
        pick = (mixed(empty.astype(np.uint64) * np.uint64(0x1_0000_0001) + np.uint64(attempt)) & np.uint64(bins - 1)).astype(np.int64)
        ok = full[pick]
        out[empty[ok]] = out[pick[ok]]
        empty = empty[~ok]
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    each = sig.reshape(-1, rows)
    total = np.arange(1, len(each) + 1, dtype=np.uint64)
    for j in range(rows):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + each[:, j])
    return total


def shingle_set(words: Words, text: str | None, k: int) -> np.ndarray:
    return np.unique(runs(words.of(text), k))


def described(docs: DataFrame, words: int = 4, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_digest (binary, null for no shingles), bands array<long>."""

    def run(batches):
        import pyarrow as pa

        known = Words()
        for b in sliced(batches):
            n, digest, bands = [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(known, text, words)
                n.append(len(s))
                if not len(s):
                    digest.append(None), bands.append(None)
                    continue
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(band_keys(signature(s, bins), rows).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_digest", "bands"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_digest binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles): the sets of some documents, as sorted 64-bit numbers."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).join(wanted, "doc_id", "left_semi")

    def run(batches):
        import pyarrow as pa

        known = Words()
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(known, t, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "shingles"])

    return staged(texts.mapInArrow(run, "doc_id long, shingles binary").dropDuplicates(["doc_id"]), "near-sets")


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int, salts: int) -> DataFrame:
    """The pairs (member, centre) that are linked, by their full sets. Members of a centre are dealt over ``salts`` groups, with a copy of the centre's set in each."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(salts)).cast("int"))
    members = salted.join(sets, salted["member"] == sets["doc_id"]).select("centre", "salt", "member", "shingles")
    groups = salted.select("centre", "salt").distinct()
    centres = groups.join(sets, groups["centre"] == sets["doc_id"]).select("centre", "salt", F.lit(None).cast("long").alias("member"), "shingles")
    dealt = members.unionByName(centres).repartition(F.col("centre"), F.col("salt")).sortWithinPartitions("centre", "salt", F.col("member").asc_nulls_first())

    def compare(batches):
        import pyarrow as pa

        mine = np.empty(0, np.uint64)
        for b in sliced(batches, 64):
            a, z = [], []
            for centre, member, shingles in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                own = np.frombuffer(shingles.as_buffer(), np.uint64)
                if member is None:
                    mine = own.copy()
                    continue
                small, large = (own, mine) if len(own) < len(mine) else (mine, own)
                if 100 * len(small) < percent * len(large):
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared = int((large[at] == small).sum())
                if 100 * shared >= percent * (len(small) + len(large) - shared):
                    a.append(member), z.append(centre)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["member", "centre"])

    return dealt.mapInArrow(compare, "member long, centre long")


class _Block:
    """An index of some members' sets; askers come one after another."""

    def __init__(self, rows: list[tuple[int, int, bool, bytes]], percent: int):
        self.percent, self.parent = percent, {}
        self.ids = np.array([r[0] for r in rows])
        self.roots = [r[1] for r in rows]
        self.out = np.array([r[2] for r in rows])
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        self.sizes = np.array([len(x) for x in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(rows), dtype=np.int32), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.keys, begin = np.unique(flat[order], return_index=True)
        self.begin = np.append(begin, len(flat))

    def _root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def links(self, who: int, root: int, shingles: bytes) -> list[tuple[int, int]]:
        own = np.frombuffer(shingles, np.uint64)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        at = at[self.keys[at] == own]
        if not len(at):
            return []
        shared = np.bincount(np.concatenate([self.owner[self.begin[k] : self.begin[k + 1]] for k in at.tolist()]), minlength=len(self.ids))
        # of two members outside the largest component only the one with the greater id asks
        near = np.flatnonzero((100 * shared >= self.percent * (len(own) + self.sizes - shared)) & (~self.out | (self.ids < who)))
        found = []
        for j in near.tolist():
            a, z = self._root(root), self._root(self.roots[j])
            if a != z:
                self.parent[max(a, z)] = min(a, z)
                other = int(self.ids[j])
                found.append((max(who, other), min(who, other)))
        return found


def _crossing(sets: DataFrame, placed: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between components inside clusters; ``placed`` is (class_id, cluster, root, n_shingles)."""
    parts = placed.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("cluster").agg(F.count("*").alias("parts"), F.max(F.struct("n", "root"))["root"].alias("main")).where("parts > 1").select("cluster", "main")
    # 100 * shared >= percent * all makes the larger set at most 100 / percent times the smaller
    size = F.floor(F.log("n_shingles") / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    rows = staged(placed.join(staged(open_, "near-open"), "cluster").select("cluster", size.alias("size"), "class_id", "root", (F.col("root") != F.col("main")).alias("out")), "near-members")
    asking = rows.where("out").withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    held = rows.groupBy("cluster", "size").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    asked = asking.groupBy("cluster", "size").agg(F.ceil(F.count("*") / block).cast("int").alias("turns"))
    tiles = staged(held.join(asked, ["cluster", "size"]), "near-tiles")
    dealt_over = lambda n: F.pmod(F.xxhash64("class_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside = rows.join(tiles, ["cluster", "size"]).select("cluster", "size", dealt_over("blocks").alias("block"), every("turns").alias("turn"), "class_id", "root", "out", F.lit(False).alias("asks"))
    askers = asking.join(tiles, ["cluster", "size"]).select("cluster", "size", every("blocks").alias("block"), dealt_over("turns").alias("turn"), "class_id", "root", "out", F.lit(True).alias("asks"))
    both = staged(inside.unionByName(askers), "near-asking")
    tile = ["cluster", "size", "block", "turn"]
    dealt = both.join(sets, both["class_id"] == sets["doc_id"]).select(F.struct(*tile).alias("tile"), "class_id", "root", "out", "asks", "shingles")
    dealt = dealt.repartition(F.col("tile")).sortWithinPartitions("tile", "asks", "class_id")

    def compare(batches):
        import pyarrow as pa

        at, members, index = None, [], None
        for b in sliced(batches, 64):
            a, z = [], []
            for tile, who, root, out, asks, shingles in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if tile != at:
                    at, members, index = tile, [], None
                if not asks:
                    members.append((who, root, out, shingles))
                    continue
                if index is None and members:
                    index, members = _Block(members, percent), []
                for x, y in index.links(who, root, shingles) if index else []:
                    a.append(x), z.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["member", "centre"])

    return dealt.mapInArrow(compare, "member long, centre long")


def components(links: DataFrame) -> DataFrame:
    """(member, root): for every id in ``links`` (member > centre) but the roots, the smallest id it can reach."""
    edges = staged(links.select("member", "centre").distinct(), "near-links")
    while True:
        parents = staged(edges.groupBy("member").agg(F.min("centre").alias("parent")), "near-parents")
        both = edges.join(parents, "member")
        rest = staged(both.where(F.col("centre") != F.col("parent")).select(F.greatest("centre", "parent").alias("member"), F.least("centre", "parent").alias("centre")), "near-rest")
        if rest.isEmpty():
            dropped(edges, rest)
            break
        before = (edges, rest, parents)
        edges = staged(rest.union(parents.select("member", F.col("parent").alias("centre"))).distinct(), "near-links")
        dropped(*before)
    while True:
        above = parents.select(F.col("member").alias("parent"), F.col("parent").alias("above"))
        jumped = staged(parents.select("member", "parent").join(above, "parent", "left").select("member", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "near-parents")
        dropped(parents)
        parents = jumped
        if jumped.where("moved").isEmpty():
            return jumped.select("member", F.col("parent").alias("root"))


def linked(docs: DataFrame, words: int = 4, percent: int = 80, bins: int = BINS, rows: int = ROWS, salts: int = 64, block: int = 512) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    all_rows = staged(described(docs, words, bins, rows), "near-described")
    paired = F.col("set_digest").isNotNull() & F.col("doc_id").isNotNull()
    some = all_rows.where(paired)
    if not some.groupBy("doc_id").agg(F.min("set_digest").alias("a"), F.max("set_digest").alias("z")).where("a != z").isEmpty():
        return _linked_by_rows(docs, words=words, percent=percent, bins=bins, rows=rows, salts=salts, block=block)
    classes_of = staged(some.groupBy("set_digest").agg(F.min("doc_id").alias("class_id")), "near-classes")
    membership = staged(some.select("doc_id", "set_digest").join(classes_of, "set_digest").select("doc_id", "class_id"), "near-membership")
    classes = some.join(classes_of.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    keys = staged(classes.select(F.col("doc_id").alias("class_id"), F.explode("bands").alias("key")), "near-keys")
    buckets = staged(keys.groupBy("key").agg(F.min("class_id").alias("centre"), F.count("*").alias("n")).where("n > 1").select("key", "centre"), "near-buckets")
    stars = staged(keys.join(buckets, "key").where(F.col("class_id") != F.col("centre")).select(F.col("class_id").alias("member"), "centre").distinct(), "near-stars")
    starred = staged(stars.select(F.col("member").alias("doc_id")).union(stars.select("centre")).distinct(), "near-starred")
    sizes = classes.select(F.col("doc_id").alias("class_id"), "n_shingles")
    sets = _sets(docs, starred, words)
    links = staged(_confirmed(sets, stars, percent, salts), "near-confirmed")
    dropped(keys, buckets)
    roots, clusters = components(links), components(stars)

    reach = lambda df, name: df.select(F.col("member").alias("class_id"), F.col("root").alias(name))
    placed = starred.withColumnRenamed("doc_id", "class_id").join(reach(clusters, "cluster"), "class_id", "left").join(reach(roots, "root"), "class_id", "left").join(sizes, "class_id")
    placed = staged(placed.select("class_id", F.coalesce("cluster", "class_id").alias("cluster"), F.coalesce("root", "class_id").alias("root"), "n_shingles"), "near-placed")
    extra = staged(_crossing(sets, placed, percent, block), "near-crossing")
    if not extra.isEmpty():
        roots = components(links.union(extra))

    of_class = membership.join(roots, membership["class_id"] == roots["member"], "left").select("doc_id", F.coalesce("root", "class_id").alias("component_id"))
    # a component's smallest id is the smallest of its classes' smallest ids
    single = all_rows.where(~paired).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = some.select("doc_id", "n_shingles").join(of_class.dropDuplicates(["doc_id"]), "doc_id")
    return full.unionByName(single).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``, written, so that a row has one number however often it is read."""
    return staged(docs.withColumn("__row", F.monotonically_increasing_id()), "near-numbered")


def _linked_by_rows(docs: DataFrame, **options) -> DataFrame:
    """``linked`` where an id has several texts: rows are compared, and those of one id count as linked."""
    rows = _numbered(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")))
    own = linked(rows.where("doc_id is not null").select(F.col("__row").alias("doc_id"), "text"), **options).select(F.col("doc_id").alias("__row"), "n_shingles", F.col("component_id").alias("part"))
    own = staged(own.join(rows.select("__row", "doc_id"), "__row"), "near-rows")
    first = own.groupBy("doc_id").agg(F.min("part").alias("centre"))
    links = own.select("doc_id", F.col("part").alias("member")).distinct().join(first, "doc_id").where(F.col("member") != F.col("centre"))
    roots = components(links.select("member", "centre"))
    whole = own.join(roots, own["part"] == roots["member"], "left").select("doc_id", "n_shingles", F.coalesce("root", "part").alias("part"))
    least = whole.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    full = whole.join(least, "part").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    without = described(rows.where("doc_id is null"), options["words"]).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return full.unionByName(without)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, all columns as they were. Where ids are repeated or null, each row is a document of its own."""
    docs_id = docs["doc_id"].cast("long")
    if docs.groupBy(docs_id.alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null").isEmpty():
        keep = linked(docs, **options).where("kept").select(F.col("doc_id").alias("__keep_id"))
        return docs.join(keep, docs_id.eqNullSafe(keep["__keep_id"]), "left_semi")
    # the row stands in a column of its own, so that no name of it can clash
    rows = _numbered(docs.select(F.struct("*").alias("row")))
    own = linked(rows.select(F.col("__row").alias("doc_id"), F.col("row.text").alias("text")), **options).select(F.col("doc_id").alias("__row"), "component_id")
    ids = rows.select("__row", F.col("row.doc_id").cast("long").alias("id"))
    order = F.struct(F.col("id").isNull(), F.col("id"), "__row")
    keep = own.join(ids, "__row").groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(keep, "__row", "left_semi").select("row.*")
