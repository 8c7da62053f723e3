"""Small packages written by hand."""

import io
import zipfile

NS = 'xmlns:hp="urn:paragraph" xmlns:hs="urn:section" xmlns:hc="urn:core" xmlns:hh="urn:head"'
HEADER = f"""<?xml version="1.0" encoding="UTF-8"?><hh:head {NS}><hh:refList>
<hh:fontfaces><hh:fontface lang="HANGUL"><hh:font id="0" face="Batang"/></hh:fontface><hh:fontface lang="LATIN"><hh:font id="1" face="Times"/></hh:fontface></hh:fontfaces>
<hh:borderFills><hh:borderFill id="1"><hh:leftBorder type="SOLID" width="0.12 mm" color="#0000FF"/><hh:rightBorder type="NONE" width="0.1 mm"/><hc:fillBrush><hc:winBrush faceColor="#00FF0000"/></hc:fillBrush></hh:borderFill>
<hh:borderFill id="2"><hh:leftBorder type="NONE"/></hh:borderFill></hh:borderFills>
<hh:charProperties><hh:charPr id="1" height="1000" textColor="#112233" shadeColor="#FFFFFF"><hh:fontRef hangul="0"/></hh:charPr><hh:charPr id="9" height="950" textColor="#000000" spacing="-5" condense="0"><hh:bold/><hh:underline color="#0000FF" shape="DASHED"/></hh:charPr></hh:charProperties>
<hh:paraProperties><hh:paraPr id="1"><hh:align horizontal="LEFT"/><hh:lineSpacing type="PERCENT" value="160"/></hh:paraPr><hh:paraPr id="2"><hh:align horizontal="CENTER"/></hh:paraPr></hh:paraProperties>
<hh:styles><hh:style id="0" type="PARA" name="Body" engName="Normal" paraPrIDRef="1" charPrIDRef="1"/></hh:styles></hh:refList></hh:head>"""


def t(text):
    return f"<hp:t>{text}</hp:t>"


def run(*inner, char="1"):
    return f'<hp:run charPrIDRef="{char}">{"".join(inner)}</hp:run>'


def p(*inner, style="0", para="1", lines=(), more=""):
    segs = "".join(f'<hp:lineseg textpos="{a}" vertpos="{b}" vertsize="{c}" textheight="{c}" horzpos="0" horzsize="7200"/>' for a, b, c in lines)
    array = f"<hp:linesegarray>{segs}</hp:linesegarray>" if lines else ""
    return f'<hp:p id="7" paraPrIDRef="{para}" styleIDRef="{style}"{more}>{"".join(inner)}{array}</hp:p>'


def tc(row, col, *inner, w=28346, h=5669, cs=1, rs=1, border="1"):
    return f'<hp:tc borderFillIDRef="{border}"><hp:subList vertAlign="CENTER">{"".join(inner)}</hp:subList><hp:cellAddr colAddr="{col}" rowAddr="{row}"/><hp:cellSpan colSpan="{cs}" rowSpan="{rs}"/><hp:cellSz width="{w}" height="{h}"/></hp:tc>'


def tbl(*rows, attrs='rowCnt="2" colCnt="2" borderFillIDRef="1"'):
    return f"<hp:tbl {attrs}>{''.join(f'<hp:tr>{r}</hp:tr>' for r in rows)}</hp:tbl>"


def section(*children):
    return f'<?xml version="1.0" encoding="UTF-8"?><hs:sec {NS}>{"".join(children)}</hs:sec>'


PAGE = '<hp:secPr><hp:pagePr width="59528" height="84188"><hp:margin top="5668" right="8504" bottom="4252" left="8504"/></hp:pagePr></hp:secPr>'


def package(*sections, more=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/zip", compress_type=zipfile.ZIP_STORED)
        z.writestr("Contents/header.xml", HEADER, compress_type=zipfile.ZIP_DEFLATED)
        for k, s in enumerate(sections):
            z.writestr(f"Contents/section{k}.xml", s, compress_type=zipfile.ZIP_DEFLATED)
        z.writestr("Contents/content.hpf", '<?xml version="1.0"?><opf:package xmlns:opf="urn:opf"><opf:manifest><opf:item id="header" href="Contents/header.xml"/></opf:manifest></opf:package>')
        z.writestr("META-INF/manifest.xml", '<?xml version="1.0"?><m:manifest xmlns:m="urn:m"><m:file-entry m:full-path="/"/></m:manifest>')
        for name, body in more:
            z.writestr(name, body)
    return out.getvalue()


def frame(spark, *contents):
    return spark.createDataFrame([(f"doc{k}", bytearray(c)) for k, c in enumerate(contents)], "path string, content binary")


def unzipped(content):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {i.filename: z.read(i) for i in z.infolist()}
