"""A plain recursive writer of a section's HTML, to compare the pieces of ``render`` with."""

import html as _html

from quiremill.functions import units as U
from quiremill.operators import render as R
from quiremill.operators.keep import kept
from quiremill.operators.nodes import SECTION
from quiremill.operators import styles as Y
from pyspark.sql import functions as F


def _css(entries) -> str:
    return "; ".join(f"{k}:{v}" for k, v in entries.items() if v)


def _px(value) -> str | None:
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return None if number >= U.UNSET else f"{number / U.UNITS_PER_INCH * 96:.2f}px"


class Writer:
    """Pages of one section. Rows are dicts; ``lines`` asks for absolutely placed lines where a paragraph has any."""

    def __init__(self, rows: list[dict], lines: bool):
        self.lines = lines
        self.rows = {r["pos"]: r | {"a": {e["key"].rpartition(":")[2]: e["value"] for e in (r["attrs"] if r["attrs"] is not None else [])}, "kids": []} for r in rows}
        for r in self.rows.values():
            if (up := self.rows.get(r["parent_pos"])) is not None:
                up["kids"].append(r)

    def below(self, r: dict, tag: str):
        for k in r["kids"]:
            if k["tag"] == tag:
                yield k
            yield from self.below(k, tag)

    def child(self, r: dict | None, *path: str) -> dict | None:
        for tag in path:
            r = next((k for k in r["kids"] if k["tag"] == tag), None) if r else None
        return r

    def segments(self, p: dict) -> list[dict]:
        array = self.child(p, "linesegarray")
        return [k for k in array["kids"] if k["tag"] == "lineseg"] if array else []

    @staticmethod
    def style(r: dict) -> dict:
        return {e["key"]: e["value"] for e in (r["css"] if r["css"] is not None else [])}

    @staticmethod
    def border(r: dict) -> dict:
        none = [{"key": f"border-{s}", "value": "none"} for s in ("left", "right", "top", "bottom")]
        return {e["key"]: e["value"] for e in (r["border"] if r["border"] is not None else none)}

    @staticmethod
    def data_id(r: dict) -> str:
        return f' data-id="{int(r["gid"])}"' if r["gid"] is not None and r["gid"] == r["gid"] else ""

    def blocks(self, kids: list[dict], in_table: bool = False) -> str:
        return "".join(self.paragraph(r, in_table) if r["tag"] == "p" else self.table(r) for r in kids if r["tag"] in ("p", "tbl"))

    @staticmethod
    def edged(text: str) -> str:
        """Escaped, with spaces at the ends that stay visible."""
        core = text.strip(" ")
        lead = len(text) - len(text.lstrip(" "))
        return "&nbsp;" * lead + _html.escape(core) + "&nbsp;" * (len(text) - lead - len(core))

    def paragraph(self, p: dict, in_table: bool) -> str:
        style, segs = self.style(p), self.segments(p)
        gap = p["gap"] if in_table or not self.lines else None
        tables = next(self.below(p, "tbl"), None) is not None
        if in_table and len(segs) == 1 and not any("\n" in (t["text"] or "") for t in self.below(p, "t")):
            style["white-space"] = "nowrap"
        if gap:
            style["margin-bottom"] = gap
        if self.lines and not in_table and not tables and segs:
            return self.placed_lines(p, segs, style)
        out, spans = [], []

        def close() -> None:
            if spans:
                out.append(f'<p{self.data_id(p)} style="{_css(style)}">{"".join(spans)}</p>')
                spans.clear()

        runs = [r for r in p["kids"] if r["tag"] == "run"]
        for r in runs:
            inner = [k for k in r["kids"] if k["tag"] == "tbl"]
            if inner:
                close()
                out += [self.table(t) for t in inner]
                continue
            look = _css(self.style(r))
            for t in r["kids"]:
                if t["tag"] == "t" and t["text"]:
                    spans.append(f'<span style="{look}">{self.edged(t["text"])}</span>' if look else self.edged(t["text"]))
        close()
        if out:
            return "".join(out)
        if segs:
            style |= {k: v for k, v in (("line-height", _px(segs[0]["a"].get("textheight"))), ("min-height", _px(segs[0]["a"].get("vertsize")))) if v}
        look = _css(self.style(runs[0])) if runs and runs[0]["a"].get("charPrIDRef") else ""
        blank = f'<span style="{look}">&nbsp;</span>' if look else "&nbsp;"
        return f'<p{self.data_id(p)} style="{_css(style)}">{blank}</p>'

    def placed_lines(self, p: dict, segs: list[dict], style: dict) -> str:
        runs = [(t["text"] or "", _css(dict(sorted(self.style(r).items())))) for r in p["kids"] if r["tag"] == "run" for t in r["kids"] if t["tag"] == "t"]
        out = []
        for s in segs:
            a, z = int(s["start"]), int(s["end"])
            spans, at = [], 0
            for text, look in runs:
                part = text[max(0, a - at) : max(0, z - at)]
                at += len(text)
                if part and spans and spans[-1][1] == look:
                    spans[-1] = (spans[-1][0] + part, look)
                elif part:
                    spans.append((part, look))
            place = {k: _px(s["a"].get(v)) or "0px" for k, v in (("left", "horzpos"), ("top", "vertpos"), ("width", "horzsize"), ("height", "vertsize"))}
            inner = "".join(f'<span style="{look}">{_html.escape(t)}</span>' for t, look in spans) or "&nbsp;"
            out.append(f'<div class="line"{self.data_id(p)} style="{_css(place | {"line-height": _px(s["a"].get("textheight"))})}">{inner}</div>')
        box = {e["key"]: e["value"] for e in (p["box_css"] if p["box_css"] is not None else [])}
        if any(box.values()):
            b = p["box"]
            size = {"position": "absolute", "left": f"{b['left']:.2f}px", "top": f"{b['top']:.2f}px", "width": f"{b['right'] - b['left']:.2f}px", "height": f"{b['bottom'] - b['top']:.2f}px"}
            out.insert(0, f'<div class="box" style="{_css(box | size)}"></div>')
        return "".join(out)

    def table(self, t: dict, rows: list[dict] | None = None, scaled: bool = False) -> str:
        style = {"width": _px(self.child(t, "sz")["a"].get("width")) if self.child(t, "sz") else None}
        if not t["borderless"]:
            style |= {k: v for k, v in self.border(t).items() if k.startswith("border-")}
        if (pos := self.child(t, "pos")) and pos["a"].get("horzAlign") == "CENTER":
            style |= {"margin-left": "auto", "margin-right": "auto"}
        spacing = _px(t["a"].get("cellSpacing"))
        if spacing and spacing != "0.00px":
            style |= {"border-collapse": "separate", "border-spacing": spacing}
        elif t["separate"]:
            style |= {"border-collapse": "separate", "border-spacing": "0px"}
        scaled = scaled and t["scale"] is not None
        if scaled:
            style |= {"transform": f"scaleY({t['scale']:.4f})", "transform-origin": "top left", "display": "inline-block"}
        margin = self.child(t, "inMargin")
        padding = _px(margin["a"].get("left")) if margin else None
        body = "".join("<tr>" + "".join(self.cell(c, padding) for c in r["kids"] if c["tag"] == "tc") + "</tr>" for r in (rows if rows is not None else [k for k in t["kids"] if k["tag"] == "tr"]))
        out = f'<table style="{_css(style)}">{body}</table>'
        return f'<div class="table-scale" style="height:{t["room"]}; overflow:hidden">{out}</div>' if scaled else out

    def cell(self, c: dict, padding: str | None) -> str:
        style = self.border(c)
        if size := self.child(c, "cellSz"):
            style["width"] = _px(size["a"].get("width"))
        margin = self.child(c, "cellMargin")
        style["padding"] = _px(margin["a"].get("left")) if margin else padding
        inner, content = self.child(c, "subList"), "&nbsp;"
        if inner:
            content = self.blocks(inner["kids"], in_table=True)
            style["vertical-align"] = {"CENTER": "middle", "BOTTOM": "bottom"}.get(inner["a"].get("vertAlign"))
        span = (self.child(c, "cellSpan") or {"a": {}})["a"]
        spans = "".join(f' {k.lower()}="{span[k]}"' for k in ("colSpan", "rowSpan") if span.get(k) not in (None, "", "1"))
        return f'<td{self.data_id(c)} style="{_css(style)}"{spans}>{content}</td>'

    def pages(self, page_of: dict, chunk_of: dict, page_style: str):
        root = next(r for r in self.rows.values() if r["parent_pos"] is None)
        by_page: dict[int, list[dict]] = {}
        for k in root["kids"]:
            by_page.setdefault(page_of[k["pos"]], []).append(k)
        for number, kids in sorted(by_page.items()):
            rows = [k for k in kids[0]["kids"] if k["tag"] == "tr"] if kids[0]["tag"] == "tbl" else []
            parts: dict[int, list[dict]] = {}
            for r in rows:
                parts.setdefault(chunk_of.get(r["pos"], 0), []).append(r)
            if len(parts) > 1:
                bodies = [self.table(kids[0], p, True) for _, p in sorted(parts.items())]
            else:
                bodies = ["".join(self.table(k, None, True) if k["tag"] == "tbl" else self.blocks([k]) for k in kids)]
            for extra, body in enumerate(bodies):
                yield number + extra, f'<div class="page" style="{page_style}">{body}</div>'


def pages(elems, header, node_table=None, lines=False):
    """{(section_no, page_no): html}"""
    rows = kept(R.styled(elems, header, node_table)).join(R.page_of_children(elems), [*SECTION, "pos"], "left")
    rows = kept(rows.join(R.table_row_chunks(elems).withColumnRenamed("tr_pos", "pos").select(*SECTION, "pos", "chunk_no"), [*SECTION, "pos"], "left"))
    spans, boxes = R.line_looks(rows)
    for more in (R.gaps_below(rows), R.table_looks(rows), spans, boxes):
        rows = rows.join(more, [*SECTION, "pos"], "left")
    found = {}
    for r in rows.withColumn("box_css", U.box_entries(F.col("css"))).collect():
        found.setdefault(r.section_no, []).append(r.asDict(recursive=True))
    css = {r.section_no: "; ".join(f"{k}:{r[v]}" for k, v in (("width", "width"), ("min-height", "height"), ("height", "height"), ("padding", "padding")) if r[v] is not None) for r in Y.page_styles(elems).collect()}
    out = {}
    for no, some in found.items():
        some.sort(key=lambda r: r["pos"])
        page_of, chunk_of = ({r["pos"]: r[k] for r in some if r[k] is not None} for k in ("page_no", "chunk_no"))
        out |= {(no, n): h for n, h in Writer(some, lines).pages(page_of, chunk_of, css.get(no, ""))}
    return out
