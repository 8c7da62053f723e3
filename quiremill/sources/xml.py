"""XML as a table of elements, and back.

``elements`` has a row for each element in document order. ``pos`` is its number, ``end_pos`` that of its last descendant, so
that containment is an interval; ``p_pos`` and its like are the nearest element of a kind at or above it, ``run_above`` the nearest
run strictly above, ``top_pos`` the child of the root it is in, which saves joins to ancestors.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.operators.keep import kept
from quiremill.sources.pieces import in_pieces, is_last, of_batches

ELEMENTS = """doc_id string, entry string, pos int, parent_pos int, end_pos int, depth int, tag string, ns string, prefix string,
 attrs array<struct<key:string,value:string>>, text string, tail string, child_no int, p_pos int, run_pos int, tbl_pos int, tc_pos int, outer_tbl_pos int, run_above int, top_pos int"""
ELEMENTS = " ".join(ELEMENTS.split())
_KINDS = ("p", "run", "tbl", "tc")
DECLARATION = '<?xml version="1.0" encoding="UTF-8" standalone="yes" ?>'


class _Reader:
    """Rows of one XML text, through expat: prefixes and attribute order stay as written.

    A row is done when the text behind its element is known, which is where the next element beside it starts or its parent ends; only
    open elements and the last child of each wait, so a text of any length is read in the room of its depth.
    """

    def __init__(self):
        from xml.parsers import expat

        self.n = 0
        self.done: list[dict] = []
        self.open: list[dict] = []
        self.parser = expat.ParserCreate()
        self.parser.ordered_attributes, self.parser.buffer_text = True, True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.start, self.end, self.data

    def start(self, name: str, attrs: list[str]) -> None:
        pos, above = self.n, self.open[-1] if self.open else None
        prefix, _, tag = name.rpartition(":")
        pairs = [{"key": attrs[i], "value": attrs[i + 1]} for i in range(0, len(attrs), 2)]
        scope = dict(above["scope"]) if above and any(p["key"].startswith("xmlns") for p in pairs) else (above["scope"] if above else {})
        if not above:
            scope = {}
        for p in pairs:
            if p["key"] == "xmlns" or p["key"].startswith("xmlns:"):
                scope[p["key"][6:]] = p["value"]
        row = {"pos": pos, "parent_pos": above["pos"] if above else None, "end_pos": pos, "depth": len(self.open), "tag": tag, "ns": scope.get(prefix, ""), "prefix": prefix, "attrs": pairs, "text": None, "tail": None, "child_no": above["n"] if above else 0, "n": 0, "scope": scope, "last": None}
        for k in _KINDS:
            row[f"{k}_pos"] = pos if tag == k else above[f"{k}_pos"] if above else None
        row["outer_tbl_pos"] = above["outer_tbl_pos"] if above and above["outer_tbl_pos"] is not None else pos if tag == "tbl" else None
        row["run_above"] = above["run_pos"] if above else None
        row["top_pos"] = None if not above else pos if not above["depth"] else above["top_pos"]
        if above:
            above["n"] += 1
            self.settle(above)
        self.n += 1
        self.open.append(row)

    def settle(self, above: dict) -> None:
        if above["last"] is not None:
            self.done.append(above["last"])
            above["last"] = None

    def end(self, name: str) -> None:
        row = self.open.pop()
        row["end_pos"] = self.n - 1
        self.settle(row)
        if self.open:
            self.open[-1]["last"] = row
        else:
            self.done.append(row)

    def data(self, text: str) -> None:
        if not self.open:
            return
        here = self.open[-1]
        row, key = (here, "text") if here["last"] is None else (here["last"], "tail")
        row[key] = (row[key] or "") + text

    def take(self) -> list[dict]:
        out, self.done = self.done, []
        return out


def parse(body: bytes) -> list[dict]:
    reader = _Reader()
    reader.parser.Parse(body, True)
    return sorted(reader.take(), key=lambda r: r["pos"])


#: Bytes that the parser is given at a time, and rows that a batch holds at least.
_STEP, _ROWS = 1 << 17, 10_000


def elements(entries: DataFrame, keep: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """``elements`` of XML entries (doc_id, entry, body), whole or in pieces, which are put in order first (by ``tasks`` tasks); ``keep`` names further columns of ``entries`` to repeat."""
    kept = [f for f in entries.schema.fields if f.name in keep]
    schema = ELEMENTS + "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept)
    names = [n.split()[0] for n in ELEMENTS.replace("struct<key:string,value:string>", "x").split(", ")][2:]
    repeated = ["doc_id", "entry", *(f.name for f in kept)]

    def run(batches) -> Iterator:
        import pyarrow as pa

        pairs = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
        kinds = {n: pairs if n == "attrs" else pa.string() if n in ("tag", "ns", "prefix", "text", "tail") else pa.int32() for n in names}
        reader, again = _Reader(), []

        def rows():
            some = reader.take()
            same = [pa.repeat(v, len(some)) for v in again]
            return pa.RecordBatch.from_arrays([*same[:2], *(pa.array([r[n] for r in some], kinds[n]) for n in names), *same[2:]], ["doc_id", "entry", *names, *repeated[2:]])

        for b, k, n_bytes, piece_no, piece in of_batches(batches):
            if not piece_no:
                # a value of its own: a scalar of the batch would hold all of it
                reader, again = _Reader(), [pa.scalar(b.column(c)[k].as_py(), b.column(c).type) for c in range(len(repeated))]
            for at in range(0, len(piece), _STEP):
                reader.parser.Parse(piece[at : at + _STEP], False)
                if len(reader.done) >= _ROWS:
                    yield rows()
            if is_last(n_bytes, piece_no):
                reader.parser.Parse(b"", True)
                yield rows()

    if "piece_no" not in entries.columns:
        return in_pieces(entries, "body", repeated).mapInArrow(run, schema)
    by = ["doc_id", "entry", "entry_pos"]
    dealt = entries.repartition(tasks, *by) if tasks else entries.repartition(*by)
    return dealt.sortWithinPartitions(*by, "piece_no").select(*repeated, "n_bytes", "piece_no", F.col("body").alias("piece")).mapInArrow(run, schema)


def attribute(key: str, column: str = "attrs"):
    """The value of an attribute, by its local name."""
    return F.get(F.filter(column, lambda a: F.element_at(F.split(a["key"], ":"), -1) == key), F.lit(0))["value"]


#: Numbers of root children that go to one fragment, and characters of text that a fragment is handed on with.
FRAGMENT, FLUSH = 50_000, 1 << 20
_LAST = 2**31 - 1


class _Serialiser:
    """XML text of elements that come in document order, a parent before its children: holds the open elements and the text not yet handed on."""

    def __init__(self):
        self.open: list[tuple[int, str]] = []
        self.waiting: tuple | None = None
        self.out: list[str] = []
        self.size = 0

    def put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def settle(self, next_parent: int | None) -> None:
        """Write what waits to learn whether it has a child, and close what the next element is not in."""
        if self.waiting:
            pos, name, start, text, tail = self.waiting
            self.waiting = None
            if pos == next_parent:
                self.put(f"<{start}>{text}")
                self.open.append((pos, f"</{name}>{tail}"))
                return
            self.put(f"<{start}>{text}</{name}>{tail}" if text else f"<{start}/>{tail}")
        while self.open and self.open[-1][0] != next_parent:
            self.put(self.open.pop()[1])

    def take(self) -> str:
        out, self.out, self.size = "".join(self.out), [], 0
        return out


def fragments(elems: DataFrame, order: str = "pos") -> DataFrame:
    """(doc_id, entry, part, seq, text, alone): pieces of the XML of sections, in order of part and seq.

    A part is a range of the root's children; each is written by one task from sorted batches, which holds its open elements
    and ``FLUSH`` characters, so a section of any size is written by many tasks in bounded room. The root's start is the first piece and its
    end the last; ``alone`` is what the root is where it has no child.
    """
    top = F.when(F.col("parent_pos").isNull(), -1).otherwise(F.floor(F.coalesce(F.col("top_pos"), F.raise_error(F.lit("an element without its root's child"))) / FRAGMENT))
    wanted = elems.select("doc_id", "entry", top.cast("int").alias("part"), F.col(order).cast("double").alias("at"), "pos", "parent_pos", "tag", "prefix", "attrs", "text", "tail")
    by = ["doc_id", "entry", "part"]

    def run(batches) -> Iterator:
        import pyarrow as pa

        key, made, seq = None, _Serialiser(), 0

        def rows(some):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], [*by, "seq", "text", "alone"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                for r in batch.slice(at, 2048).to_pylist():
                    here = (r["doc_id"], r["entry"], r["part"])
                    if here != key:
                        if key:
                            made.settle(None)
                            yield rows([(*key, seq, made.take(), None)])
                        key, seq = here, 0
                    name = f"{r['prefix']}:{r['tag']}" if r["prefix"] else r["tag"]
                    start = name + "".join([f" {a['key']}={quoteattr(a['value'])}" for a in r["attrs"] or ()])
                    text, tail = escape(r["text"] or ""), escape(r["tail"] or "")
                    if r["part"] < 0:
                        yield rows([(*here, 0, f"<{start}>{text}", f"<{start}>{text}</{name}>" if text else f"<{start}/>"), (*here[:2], _LAST, 0, f"</{name}>", None)])
                        key = None
                        continue
                    made.settle(r["parent_pos"])
                    made.waiting = (r["pos"], name, start, text, tail)
                    if made.size >= FLUSH:
                        yield rows([(*key, seq, made.take(), None)])
                        seq += 1
        if key:
            made.settle(None)
            yield rows([(*key, seq, made.take(), None)])

    # range partitioning would sample the input; a hash of the part spreads a section's parts as well
    return wanted.repartition(*by).sortWithinPartitions(*by, "at", "pos").drop("at").mapInArrow(run, "doc_id string, entry string, part int, seq int, text string, alone string")


def written(elems: DataFrame, order: str = "pos") -> DataFrame:
    """(doc_id, entry, body): XML of the elements that are left, in the order of ``order``, with the fixed declaration.

    ``order`` may be fractional, so that new elements stand between old ones; an element comes after its parent, next to what else is below it, and
    names the child of the root it is in (``top_pos``).
    """
    pieces = fragments(elems, order).groupBy("doc_id", "entry").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "text"))).alias("all"), F.max("alone").alias("alone"))
    text = F.when(F.size("all") == 2, F.col("alone")).otherwise(F.array_join(F.transform("all", lambda x: x["text"]), ""))
    return pieces.select("doc_id", "entry", F.encode(F.concat(F.lit(DECLARATION), text), "UTF-8").alias("body"))


def written_pieces(elems: DataFrame, order: str = "pos") -> DataFrame:
    """(doc_id, entry, n_bytes, piece_no, body): ``written`` in pieces, so that no row holds a section."""
    made = kept(fragments(elems, order))
    many = made.groupBy("doc_id", "entry").agg((F.count("*") > 2).alias("__many"))
    text = F.when(F.col("__many"), F.col("text")).when(F.col("part") < 0, F.col("alone"))
    body = F.encode(F.concat(F.when(F.col("part") < 0, DECLARATION).otherwise(""), text), "UTF-8")
    number = F.shiftleft(F.col("part").cast("long"), 31) + F.col("seq")
    pieces = made.join(many, ["doc_id", "entry"]).select("doc_id", "entry", number.alias("piece_no"), body.alias("body")).where("body is not null")
    return pieces.join(pieces.groupBy("doc_id", "entry").agg(F.sum(F.octet_length("body")).alias("n_bytes")), ["doc_id", "entry"])
