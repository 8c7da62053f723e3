"""The three jobs over packages, each for all packages of a table at once: fill templates, merge edited HTML, propose edits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiremill.functions.text import normalize_patch, safe_name, stamped_name
from quiremill.operators import annotate as N
from quiremill.operators import joins as J
from quiremill.operators import mutate as M
from quiremill.operators import render as R
from quiremill.operators import sequence as S
from quiremill.operators.keep import kept
from quiremill.operators.nodes import SECTION, chunks, for_model, merged_chunks, nodes, planned_chunks, summaries, with_global_ids
from quiremill.operators.styles import centre_paragraph
from quiremill.sources import html as H
from quiremill.sources import package as P
from quiremill.sources import xml as E


@dataclass(frozen=True)
class Options:
    """Settings that the environment may give as QUIREMILL_<NAME>; what is set in code wins."""

    most_nodes: int = 60
    pictures: bool = True
    calls: int = 4

    @classmethod
    def from_environment(cls, environ: dict[str, str]) -> Options:
        def of(name: str, default):
            value = environ.get(f"QUIREMILL_{name.upper()}")
            if value is None:
                return default
            if isinstance(default, bool):
                return value.strip().lower() in {"1", "true", "yes", "y", "on"}
            try:
                return type(default)(value)
            except ValueError:
                return default

        return cls(**{f: of(f, getattr(cls, f)) for f in cls.__dataclass_fields__})


def settings_file(text: str, environ: dict[str, str]) -> dict[str, str]:
    """``environ`` with the ``NAME=value`` lines of a settings file; what the environment has already wins."""
    found = {}
    for line in text.splitlines():
        name, eq, value = line.strip().partition("=")
        if eq and name and not name.startswith("#"):
            found[name.strip()] = value.strip().strip("'\"")
    return found | environ


class Package:
    """The tables of some packages: entries, elements of sections and headers, nodes. Each is made once, for all jobs that are given the same object."""

    def __init__(self, entries: DataFrame):
        self.entries = entries
        self.sections = kept(P.sections(entries, required=True))
        # elements are many times the size of their text, so tasks are not to be merged by the size of that
        tasks, more = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), ("section_no", "entry_pos", "compress_type")
        if P.is_pieced(entries):
            self.elems = kept(E.elements(entries.join(self.sections.select("doc_id", "entry_pos", "section_no"), ["doc_id", "entry_pos"]), more, tasks))
        else:
            self.elems = kept(E.elements(self.sections.repartition(tasks, *SECTION), more))
        self.header = kept(E.elements(P.header(entries)))
        self._nodes: dict[bool, DataFrame] = {}

    @classmethod
    def of(cls, source: DataFrame | Package) -> Package:
        return source if isinstance(source, cls) else cls(source)

    def nodes(self, styles: bool = True) -> DataFrame:
        if styles not in self._nodes:
            self._nodes[styles] = kept(with_global_ids(nodes(self.elems, self.header if styles else None)))
        return self._nodes[styles]

    def repacked(self, elems: DataFrame, more: DataFrame | None = None) -> DataFrame:
        """(doc_id, content) with sections written from ``elems`` and ``more`` entries put in the place of those of the same name."""
        written = E.written_pieces(elems, "at" if "at" in elems.columns else "pos")
        new = self.sections.select("doc_id", "entry_pos", "entry", "compress_type").join(written.hint("merge"), ["doc_id", "entry"])  # few rows, long values
        return _exchanged(self.entries, new.withColumn("row", F.lit(0).cast("long")), more)


def _exchanged(entries: DataFrame, new: DataFrame | None, more: DataFrame | None) -> DataFrame:
    """(doc_id, content) of packages with ``new`` entries (in pieces) and ``more`` (doc_id, entry, body) in the place of those of the same name."""
    if more is not None:
        old = P.listed(entries).select("doc_id", "entry", "entry_pos", "compress_type")
        more = P.pieced(more.join(old, ["doc_id", "entry"], "left").select("doc_id", "entry_pos", "entry", "compress_type", "body"))
        new = more if new is None else new.unionByName(more)
    rest = P.pieced(entries.join(new.select("doc_id", "entry").distinct(), ["doc_id", "entry"], "left_anti"))
    return P.packed(rest.select(new.columns).unionByName(new))


def chunked(node_table: DataFrame, plan: DataFrame | None, most: int) -> DataFrame:
    """(section, nid, chunk_no): planned where the plan is sound, else packed; chunks that share a table are one."""
    shown = for_model(node_table).select(*SECTION, "nid", "table_idx", "row")
    if plan is None:
        return chunks(shown, most)
    good, _ = planned_chunks(shown, plan)
    left = shown.join(good.select(*SECTION).distinct(), SECTION, "left_anti")
    merged = merged_chunks(good.join(shown.select(*SECTION, "nid", "table_idx"), [*SECTION, "nid"])).select(*SECTION, "nid", F.col("chunk_no").cast("long").alias("chunk_no"))
    return merged.unionByName(chunks(left, most))


def planned(table: DataFrame, all_summaries: DataFrame, planner: N.Annotator, wording: N.Wording = N.Wording()) -> DataFrame:
    """The plan (section, chunk_id, node_ids) that a model answers with, from the nodes it is shown."""
    return kept(N.plans(planner.annotate(N.plan_prompts(for_model(table), all_summaries, wording))))


def generate(entries: DataFrame | Package, analyse: N.Annotator, fill: N.Annotator, topic: str, plan: DataFrame | N.Annotator | None = None, pictures: DataFrame | None = None, options: Options = Options(), description: str = "", reference: str = "", wording: N.Wording = N.Wording()) -> DataFrame:
    """(doc_id, content) of filled templates.

    ``plan`` is a plan of chunks, or what answers with one. ``pictures`` (doc_id, section_no, nid, seq, body) are pictures made for
    the requests; a request without one is passed over, and nodes that go without a picture go.
    """
    pkg = Package.of(entries)
    table, all_summaries = pkg.nodes(), kept(summaries(pkg.elems))
    if plan is not None and not isinstance(plan, DataFrame):
        plan = planned(table, all_summaries, plan, wording)
    chunk_of = kept(chunked(table, plan, options.most_nodes))
    shown = kept(N.analysis_prompts(for_model(table), chunk_of, all_summaries, description, wording))
    analysed = kept(analyse.annotate(shown.drop("html")))
    notes = kept(N.last_note(N.with_pairs(N.analysis(analysed), table)))
    filled = kept(fill.annotate(N.fill_prompts(shown, notes, chunk_of, topic, description, reference, wording)))
    written = J.fillable(N.fills(filled), notes.select(*SECTION, "id", "category", "action", "skip_fill"), SECTION)
    texts, requests = N.picture_requests(table, written, notes, topic, options.pictures and pictures is not None)

    elems = kept(M.filled(pkg.elems, table, texts.select(*SECTION, F.col("id").alias("nid"), "new_text")))
    more = None
    have = kept(requests.join(pictures.select(*SECTION, "nid", "seq", "body"), [*SECTION, "nid", "seq"])) if pictures is not None else None
    if have is not None:
        elems, more = _illustrated(pkg, elems, table, have)
    by_id = table.select(*SECTION, F.col("nid").alias("id"), "table_idx")
    done = (have if have is not None else requests.limit(0)).select(*SECTION, F.col("nid").alias("id"))
    cells = by_id.where("table_idx >= 0")
    gone = kept(J.deletions(notes.where("delete or category = 'instruction'"), notes.where("delete_if_no_image"), done, cells, SECTION))
    elems = kept(M.deleted_paragraphs(elems, M.node_paragraphs(table, gone.withColumnRenamed("id", "nid"))))
    hit = gone.join(cells, [*SECTION, "id"]).select(*SECTION, "table_idx")
    elems = M.deleted_tables(elems, N.removed_tables(analysed).select(*SECTION, "table_idx").unionByName(hit), table)
    return pkg.repacked(elems, more)


def _illustrated(pkg: Package, elems: DataFrame, table: DataFrame, have: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements with the pictures, and the entries that come with them: the pictures and the two manifests."""
    order = Window.partitionBy("doc_id").orderBy("section_no", "nid", "seq")
    numbered = have.join(P.next_picture_no(pkg.entries), "doc_id").withColumn("no", F.col("next_no") + F.row_number().over(order) - 1)
    kind = F.coalesce(P.picture_format(F.col("body")), F.lit("png"))
    numbered = numbered.withColumns({"item": F.concat(F.lit("image"), F.col("no").cast("string")), "media": F.concat(F.lit("image/"), kind), "entry": F.concat(F.lit("BinData/image"), F.col("no").cast("string"), F.lit("."), F.when(kind == "jpeg", "jpg").otherwise(kind)), "width_px": P.picture_size(F.col("body"))["width"]})
    used = lambda tag, key, name: pkg.elems.where(F.col("tag") == tag).select(*SECTION, E.attribute(key).alias(name))
    rows = S.allocated(numbered, used("pic", "id", "__i"), SECTION, "__i", ["nid", "seq"], "pic_id")
    rows = S.allocated(rows, used("pic", "instid", "__i"), SECTION, "__i", ["nid", "seq"], "inst_id")
    rows = S.allocated(rows, used("p", "id", "__i"), SECTION, "__i", ["nid", "seq"], "paragraph_id")
    rows = kept(rows)
    inserts = rows.select(*SECTION, "nid", "seq", "item", "width_px", "ratio", "caption", "pic_id", "inst_id", "paragraph_id")
    out = kept(M.with_pictures(elems, table, inserts, centre_paragraph(pkg.header)))
    files = rows.select("doc_id", "entry", "body")
    return out, files.unionByName(_manifests(pkg, rows))


def _manifests(pkg: Package, rows: DataFrame) -> DataFrame:
    """The content and package manifests with rows for new pictures: an item is added where neither its id nor its path is there."""
    made = []
    for name, parent, item, pairs in (
        ("Contents/content.hpf", "manifest", "item", (("id", "item"), ("href", "entry"), ("media-type", "media"), ("isEmbeded", None))),
        ("META-INF/manifest.xml", "manifest", "file-entry", (("full-path", "entry"), ("media-type", "media"))),
    ):
        tree = kept(M.with_place(E.elements(pkg.entries.where(F.col("entry") == name))))
        keys = ["id", "href"] if item == "item" else ["full-path"]
        old = tree.where(F.col("tag") == item).select("doc_id", *(E.attribute(k).alias(k.replace("-", "_")) for k in keys))
        source = dict(pairs)
        new = rows.select("doc_id", "no", *(F.col(source[k]).alias(k.replace("-", "_")) for k in keys), "media", F.col("no").alias("seq"))
        names = [k.replace("-", "_") for k in keys]
        fresh = J.upserted(old.limit(0), new, ["doc_id"], names)
        for k in names:
            fresh = fresh.join(old.select("doc_id", k), ["doc_id", k], "left_anti")
        fresh = fresh.join(new.select("doc_id", *names, "media", "no"), ["doc_id", *names])
        value = {"item": F.col("id") if "id" in names else None, "entry": F.col(names[-1]), "media": F.col("media"), None: F.lit("1")}
        attrs = F.array(*(F.struct(F.lit(k).alias("key"), value[v].alias("value")) for k, v in pairs))
        host = tree.where(F.col("tag") == parent).groupBy("doc_id", "entry").agg(F.min_by(F.struct("pos", "end_pos", "prefix", "top_pos"), "pos").alias("h"))
        top = tree.groupBy("doc_id").agg(F.max("pos").alias("top"))
        added = fresh.join(host, "doc_id").join(top, "doc_id").select("doc_id", "entry", (F.col("top") + F.col("no")).cast("int").alias("pos"), F.col("h.pos").alias("parent_pos"), F.coalesce("h.top_pos", "h.end_pos").alias("top_pos"), F.col("h.prefix").alias("prefix"), F.lit(item).alias("tag"), attrs.alias("attrs"), (F.col("h.end_pos") + F.col("no") * 1e-6 + 0.1).alias("at"))
        made.append(E.written(tree.unionByName(added, allowMissingColumns=True), "at"))
    return made[0].unionByName(made[1])


def save_from_html(entries: DataFrame | Package, edited: DataFrame, compat: bool = False, scope: DataFrame | None = None) -> DataFrame:
    """(doc_id, content) of packages with the texts of edited HTML (doc_id, html); tables none of whose cells is in it go, with the
    paragraphs that hold them. ``scope`` (doc_id, gid) limits that to the tables that were shown. HTML without any id is an error.
    """
    pkg = Package.of(entries)
    table = pkg.nodes(styles=False)
    # parsed once: the check, the texts and the tables that are gone all look at what was found
    found = kept(H.edits(edited, ["doc_id"], compat=compat).withColumnRenamed("id", "gid"))
    without = edited.select("doc_id").join(found, "doc_id", "left_anti").first()
    if without is not None:
        raise ValueError(f"the edited HTML holds no ids: {without.doc_id}")
    texts = found.where(F.col("new_text").isNotNull()).join(table.select(*SECTION, "nid", "gid"), ["doc_id", "gid"])
    shown = table.join(found.select("doc_id"), "doc_id", "left_semi")
    elems = M.without_tables(pkg.elems, M.orphan_tables(shown, found.select("doc_id", "gid"), scope))
    return pkg.repacked(M.filled(elems, table, texts.select(*SECTION, "nid", "new_text")))


def named(packages: DataFrame, kind: str, title: Column, at: Column) -> DataFrame:
    """``packages`` with the ``name`` of the file each is to be saved as: ``filled-…`` after its topic, ``edited-…`` after its file."""
    plain = F.regexp_replace(safe_name(F.trim(title), "report"), r"(?i)\.hwpx$", "")
    return packages.withColumn("name", F.concat(stamped_name(kind, plain, at), F.lit(".hwpx")))


def picture_slots(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """(doc_id, entry, prompt): the pictures of each package in order and the prompts (doc_id, seq, prompt) for them, by place; blank prompts ask for nothing."""
    slots = P.pictures(entries).select("doc_id", "picture_no", "entry")
    return J.zipped(slots, requests.select("doc_id", "seq", "prompt"), ["doc_id"], "picture_no", "seq").where(F.trim("prompt") != "").select("doc_id", "entry", "prompt")


def with_new_pictures(entries: DataFrame, made: DataFrame) -> DataFrame:
    """(doc_id, content) of packages whose picture entries (doc_id, entry, body) are exchanged."""
    if P.is_pieced(entries):
        there = made.join(P.listed(entries), ["doc_id", "entry"], "left_semi")
        return _exchanged(entries, None, there.select("doc_id", "entry", "body"))
    new = made.select("doc_id", "entry", F.col("body").alias("__body"))
    changed = entries.join(new, ["doc_id", "entry"], "left").withColumn("body", F.coalesce("__body", "body")).drop("__body")
    return P.packed(changed)


def exported_pictures(entries: DataFrame, folder: str) -> DataFrame:
    """(doc_id, path): every picture of packages as a file ``<package>-<picture>`` of a folder."""
    base = F.regexp_replace(F.element_at(F.split("doc_id", "/"), -1), r"\.[^.]*$", "")
    name = F.concat(base, F.lit("-"), F.element_at(F.split("entry", "/"), -1))
    return P.write(P.pictures(entries).select("doc_id", F.col("body").alias("content"), name.alias("file")), folder, F.col("file"))


def to_html(entries: DataFrame | Package, lines: bool = False, ids: bool = True, pieces: bool = False) -> DataFrame:
    """(doc_id, html) of packages, or (doc_id, piece_no, html): what takes HTML takes both."""
    pkg = Package.of(entries)
    if pieces:
        return R.document_pieces(pkg.elems, pkg.header, pkg.nodes(styles=False) if ids else None, lines)
    return R.documents(R.pages(pkg.elems, pkg.header, pkg.nodes(styles=False) if ids else None, lines))


def convert(spark: SparkSession, path: str, out: str, lines: bool = False, glob: str = "*.hwpx") -> DataFrame:
    """(doc_id, path): every package below a path as an HTML file of its name in the folder ``out``."""
    pages = to_html(P.read(spark, path, glob), lines, ids=False)
    name = F.concat(F.regexp_replace(F.element_at(F.split("doc_id", "/"), -1), r"\.[^.]*$", ""), F.lit(".html"))
    return P.write(pages.select("doc_id", F.encode("html", "UTF-8").alias("content")), out, name)


def page_edits(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, seq, target, new_text): what a model proposed (doc_id, answer) for pages (doc_id, page), resolved to nodes."""
    html = pages.select("doc_id", *(c for c in pages.columns if c == "piece_no"), F.col("page").alias("html"))
    labels = J.label_values(td_rows(html), ["doc_id"], ["row_no"], "cell_no")
    on_page = H.owned_text(html, ["doc_id"]).select("doc_id", F.col("id").try_cast("long").alias("id")).where("id is not null")
    proposed = N.edits(answers).withColumn("new_text", normalize_patch(F.col("new_text")))
    return J.resolved_edits(proposed, labels, on_page, ["doc_id"])


def edit_page(entries: DataFrame | Package, number: int, answers: DataFrame, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(page (doc_id, page), edits (doc_id, seq, target, new_text)): one page of each package, and what a model proposed for it."""
    pages = kept(H.page(to_html(entries, lines), ["doc_id"], number))
    return pages, page_edits(pages, answers)


def td_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row_no, cell_no, nid, text): cells with an id, row by row, found by pattern; rows without any are left out."""
    rows = H.table_rows(docs, ["doc_id"]) if "piece_no" in docs.columns else docs.select("doc_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "row"))
    cells = rows.select("doc_id", "row_no", F.posexplode(F.regexp_extract_all("row", F.lit(r'(?is)(<td[^>]*data-id="\d+"[^>]*>.*?</td>)'), F.lit(1))).alias("cell_no", "td"))
    return cells.select("doc_id", "row_no", "cell_no", F.regexp_extract("td", r'data-id="(\d+)"', 1).cast("long").alias("nid"), normalize_patch(F.col("td")).alias("text"))
