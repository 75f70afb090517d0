"""Word-processor files: DOCX, ODT and RTF, each to one XHTML document with its pictures."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

from . import book as B


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _get(e: ET.Element | None, key: str) -> str | None:
    """An attribute by its local name."""
    if e is None:
        return None
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == key), None)


def _child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for step in path:
        e = next((c for c in e if _name(c) == step), None) if e is not None else None
    return e


class _Archive:
    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = self.zip.namelist()

    def parts(self, name: str) -> list[ET.Element]:
        root = self.xml(name)
        return [] if root is None else list(root)

    def xml(self, name: str) -> ET.Element | None:
        """A part as a tree; None if it is missing or broken."""
        try:
            return ET.fromstring(self.zip.read(name)) if name in self.names else None
        except ET.ParseError:
            return None

    def below(self, folder: str) -> list[str]:
        return [n for n in self.names if n.startswith(folder) and not n.endswith("/")]


# DOCX --------------------------------------------------------------------------------------

_JUSTIFY = {"center": "center", "right": "right", "end": "right", "both": "justify", "distribute": "justify"}
#: Run properties and their tags, outermost first.
_RUN_TAGS = ("sup", "sub", "b", "i", "u", "s")


def _docx_levels(root: ET.Element | None) -> dict[str, int]:
    """Style id -> heading level, by outline level or name, inherited along ``basedOn``."""
    own: dict[str, int | None] = {}
    parent: dict[str, str | None] = {}
    for s in root if root is not None else ():
        key = _get(s, "styleId")
        if _name(s) != "style" or not key:
            continue
        outline = next((_get(x, "val") for x in s.iter() if _name(x) == "outlineLvl"), None)
        named = re.match(r"(?i)(?:heading|titre)\D*([1-9])", _get(_child(s, "name"), "val") or "")
        own[key] = int(outline) if outline and outline.isdigit() else int(named[1]) - 1 if named else None
        parent[key] = _get(_child(s, "basedOn"), "val")
    levels = {}
    for key in own:
        seen, at = set(), key
        while at in own and own[at] is None and at not in seen:  # a cycle ends the walk
            seen.add(at)
            at = parent[at]
        if own.get(at) is not None:
            levels[key] = min(own[at] + 1, 6)
    return levels


class _Docx:
    def __init__(self, rels: dict[str, str], levels: dict[str, int], bullets: dict[str, str]) -> None:
        self.rels, self.levels, self.bullets = rels, levels, bullets
        self.out: list[str] = []
        self.listed: str | None = None

    def end_list(self) -> None:
        if self.listed:
            self.out.append(f"</{self.listed}>\n")
            self.listed = None

    def blocks(self, parent: ET.Element) -> None:
        for e in parent:
            kind = _name(e)
            if kind == "p":
                self.paragraph(e)
            elif kind == "tbl":
                self.end_list()
                self.out.append("<table>\n")
                self.blocks(e)
                self.out.append("</table>\n")
            elif kind in ("tr", "tc"):
                tag = "tr" if kind == "tr" else "td"
                self.out.append(f"<{tag}>")
                self.blocks(e)
                self.out.append(f"</{tag}>" + ("\n" if kind == "tr" else ""))
            else:
                self.blocks(e)

    def inline(self, e: ET.Element, marks: tuple[str, ...] = ()) -> str:
        kind = _name(e)
        if kind == "t":
            inner = B.text(e.text or "")
            return "".join(f"<{m}>" for m in marks) + inner + "".join(f"</{m}>" for m in reversed(marks))
        if kind == "br":
            return "<br/>"
        if kind == "tab":
            return "&#160;" * 4
        if kind == "blip":
            target = self.rels.get(_get(e, "embed") or "")
            return f'<img src="{B.attr(target)}" alt=""/>' if target else ""
        if kind in ("pPr", "rPr"):
            return ""
        if kind == "r":
            marks = self.marks(_child(e, "rPr"))
        inner = "".join(self.inline(c, marks) for c in e)
        if kind == "hyperlink":
            target = self.rels.get(_get(e, "id") or "")
            return f'<a href="{B.attr(target)}">{inner}</a>' if target else inner
        return inner

    @staticmethod
    def marks(props: ET.Element | None) -> tuple[str, ...]:
        """The tags of a run. A property that is there counts, whatever its value."""
        have = {}
        for p in props if props is not None else ():
            have[_name(p)] = _get(p, "val")
        on = {
            "sup": have.get("vertAlign") == "superscript", "sub": have.get("vertAlign") == "subscript", "b": "b" in have or "bCs" in have,
            "i": "i" in have or "iCs" in have, "u": "u" in have, "s": "strike" in have,
        }
        return tuple(t for t in _RUN_TAGS if on[t])

    def paragraph(self, p: ET.Element) -> None:
        props = _child(p, "pPr")
        level = self.levels.get(_get(_child(props, "pStyle"), "val") or "")
        number = _get(_child(props, "numPr", "numId"), "val")
        side = _JUSTIFY.get(_get(_child(props, "jc"), "val") or "")
        klass = f' class="docx-{side}"' if side else ""
        inner = "".join(self.inline(c) for c in p)
        if level is not None:
            self.end_list()
            self.out.append(f"<h{level}{klass}>{inner}</h{level}>\n")
        elif number and number != "0":
            kind = "ul" if self.bullets.get(number, "bullet") == "bullet" else "ol"
            if kind != self.listed:
                self.end_list()
                self.out.append(f"<{kind}>\n")
                self.listed = kind
            self.out.append(f"<li>{inner}</li>\n")
        else:
            self.end_list()
            if inner:
                self.out.append(f"<p{klass}>{inner}</p>\n")


def read_docx(data: bytes, stem: str) -> dict:
    z = _Archive(data)
    terms = B.Terms()
    for e in z.parts("docProps/core.xml"):
        kind = _name(e)
        if kind == "keywords":
            for word in (e.text or "").split(","):
                terms.add("subject", word)
        elif kind in ("created", "modified"):
            if terms.get("date") is None:
                terms.put("date", e.text)
        elif kind in ("title", "description", "language"):
            terms.put(kind, e.text)
        elif kind in ("creator", "subject"):
            terms.add(kind, e.text)
        elif kind == "lastModifiedBy":
            terms.add("contributor", e.text)
    rels = {r.get("Id"): r.get("Target") for r in z.parts("word/_rels/document.xml.rels") if r.get("Id")}
    bullets = {}
    for a in z.parts("word/numbering.xml"):
        if _name(a) == "abstractNum":  # looked up by numId, as the data model has it
            formats = [_get(f, "val") for f in a.iter() if _name(f) == "numFmt"]
            bullets[_get(a, "abstractNumId")] = formats[-1] if formats else "decimal"
    main = z.xml("word/document.xml")
    if main is None:
        raise ValueError("word/document.xml is missing or broken")
    d = _Docx(rels, _docx_levels(z.xml("word/styles.xml")), bullets)
    d.blocks(_child(main, "body") if _child(main, "body") is not None else main)
    d.end_list()
    pictures = [(re.sub(r"[/.]", "_", n[5:]), n[5:], z.zip.read(n)) for n in z.below("word/media/")]
    return B.single(stem, terms.rows, "".join(d.out), pictures)


# ODT ---------------------------------------------------------------------------------------


def _odt_headings(root: ET.Element | None) -> set[str]:
    styles = (e for e in root.iter() if _name(e) in ("style", "list-style")) if root is not None else ()
    return {n for e in styles if (n := _get(e, "name") or "").startswith("Heading") or (_get(e, "parent-style-name") or "").startswith("Heading")}


class _Odt:
    """Lists are flat: only the outermost one shows. Spans are marked by their style's name."""

    def __init__(self, headings: set[str]) -> None:
        self.headings = headings
        self.out: list[str] = []

    def blocks(self, parent: ET.Element, depth: int = 0) -> None:
        for e in parent:
            kind = _name(e)
            if kind in ("p", "h"):
                tag = self.tag(e, kind)
                self.out.append(f"<{tag}>{self.inline(e)}</{tag}>\n")
            elif kind == "list":
                self.around(e, "<ul>\n" if depth == 0 else "", "</ul>\n" if depth == 0 else "", depth + 1)
            elif kind == "list-item":
                self.around(e, "<li>" if depth == 1 else "", "</li>\n" if depth == 1 else "", depth)
            elif kind == "table":
                self.around(e, "<table>\n", "</table>\n", depth)
            elif kind == "table-row":
                self.around(e, "<tr>", "</tr>\n", depth)
            elif kind == "table-cell":
                self.around(e, "<td>", "</td>", depth)
            else:
                self.blocks(e, depth)

    def around(self, e: ET.Element, before: str, after: str, depth: int) -> None:
        self.out.append(before)
        self.blocks(e, depth)
        self.out.append(after)

    def tag(self, e: ET.Element, kind: str) -> str:
        style, outline = _get(e, "style-name") or "", _get(e, "outline-level") or ""
        if kind == "h" and outline.isdigit() and int(outline) > 0:
            return f"h{min(int(outline), 6)}"
        if style in self.headings:
            m = re.search(r"(?i)heading[_ ]*(?:20[_ ]*)?([1-6])", style)
            return f"h{m[1] if m else 1}"
        return "p"

    def inline(self, e: ET.Element) -> str:
        parts = [B.text(e.text or "")]
        for c in e:
            kind, inner = _name(c), ""
            if kind == "span":
                style = (_get(c, "style-name") or "").lower()
                marks = [t for t, names in (("strong", ("bold", "strong")), ("em", ("italic", "emphasis")), ("u", ("underline",))) if any(n in style for n in names)]
                inner = "".join(f"<{m}>" for m in marks) + self.inline(c) + "".join(f"</{m}>" for m in reversed(marks))
            elif kind == "line-break":
                inner = "<br/>"
            elif kind == "tab":
                inner = "&#9;"
            elif kind == "s":
                inner = " " * int(_get(c, "c") or 1)
            elif kind == "a":
                inner = f'<a href="{B.attr(_get(c, "href") or "")}">{self.inline(c)}</a>'
            elif kind == "image":
                inner = f'<img src="images/{B.attr((_get(c, "href") or "").removeprefix("Pictures/"))}" alt=""/>'
            else:
                inner = self.inline(c)
            parts += [inner, B.text(c.tail or "")]
        return "".join(parts)


def read_odt(data: bytes, stem: str) -> dict:
    z = _Archive(data)
    terms = B.Terms()
    meta = z.xml("meta.xml")
    for e in meta.iter() if meta is not None else ():
        kind = _name(e)
        if kind in ("creator", "initial-creator"):
            terms.add("creator", e.text)
        elif kind == "keyword":
            terms.add("subject", e.text)
        elif kind in ("title", "description", "subject", "language", "date", "creation-date"):
            terms.put({"subject": "description", "creation-date": "date"}.get(kind, kind), e.text)
    content = z.xml("content.xml")
    if content is None:
        raise ValueError("content.xml is missing or broken")
    d = _Odt(_odt_headings(z.xml("styles.xml")) | _odt_headings(content))
    for e in content.iter():
        if _name(e) == "text" and e.tag.startswith("{urn:oasis:names:tc:opendocument:xmlns:office"):
            d.blocks(e)
    pictures = [(re.sub(r"[/.]", "_", n), "images/" + n.removeprefix("Pictures/"), z.zip.read(n)) for n in z.below("Pictures/")]
    return B.single(stem, terms.rows, "".join(d.out), pictures)


# RTF ---------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([^\\{}]+)", re.S)
#: Groups that hold no body text.
_RTF_ASIDE = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "headerl", "headerr", "footerl", "footerr", "generator", "themedata", "datastore", "latentstyles", "listtable", "listoverridetable", "object", "xmlnstbl"}
#: Character properties and their tags, innermost first.
_RTF_MARKS = (("b", "strong"), ("i", "em"), ("ul", "u"), ("strike", "del"), ("super", "sup"), ("sub", "sub"))
_RTF_SIDES = {"qc": "center", "qr": "right", "qj": "justify", "ql": ""}
_RTF_CHARS = {"tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "line": "\n"}


def rtf_html(source: str) -> str:
    """The paragraphs of an RTF text. Groups nest on a stack, so depth is not limited."""
    out: list[str] = []
    para: list[str] = []
    run: list[str] = []
    state: dict = {"uc": 1, "side": ""}
    stack: list[dict] = []
    skip = 0

    def end_run() -> None:
        if run:
            piece = B.text("".join(run))
            run.clear()
            if para or piece.strip():
                for key, tag in _RTF_MARKS:
                    piece = f"<{tag}>{piece}</{tag}>" if state.get(key) else piece
                para.append(f'<span style="font-variant: small-caps">{piece}</span>' if state.get("scaps") else piece)

    def end_paragraph() -> None:
        end_run()
        if para:
            klass = f' class="{state["side"]}"' if state["side"] else ""
            out.append(f"<p{klass}>{''.join(para)}</p>\n")
            para.clear()

    def put(chars: str) -> None:
        nonlocal skip
        if skip:  # what stands for a character that \u gave
            skip, chars = max(0, skip - len(chars)), chars[skip:]
        if not state.get("aside"):
            run.append(chars)

    for m in _TOKEN.finditer(source):
        word, value, code, sign, brace, chars = m.groups()
        if brace == "{":
            end_run()
            stack.append(dict(state))
        elif brace == "}":
            end_run()
            state = stack.pop() if stack else state
        elif chars is not None:
            put(re.sub(r"[\r\n]", "", chars))
        elif code is not None:
            put(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif sign is not None:
            if sign == "*":
                state["aside"] = True
            elif sign in "\r\n":
                end_paragraph()
            else:
                put({"~": "\u00a0", "_": "\u2011", "-": ""}.get(sign, sign))
        elif word in _RTF_ASIDE:
            state["aside"] = True
        elif state.get("aside"):
            pass
        elif word in ("par", "sect", "page"):
            end_paragraph()
        elif word == "u":
            skip = 0
            put(chr(int(value or 0) % 65536))
            skip = state["uc"]
        elif word == "uc":
            state["uc"] = int(value or 1)
        elif word in _RTF_CHARS:
            put(_RTF_CHARS[word])
        elif word in _RTF_SIDES:
            state["side"] = _RTF_SIDES[word]
        elif word == "pard":
            state["side"] = ""
        elif word in ("plain", "ulnone", "nosupersub"):
            end_run()
            for key in {"plain": ("b", "i", "ul", "strike", "super", "sub", "scaps"), "ulnone": ("ul",), "nosupersub": ("super", "sub")}[word]:
                state.pop(key, None)
        elif word in ("b", "i", "ul", "strike", "super", "sub", "scaps"):
            end_run()
            state[word] = value != "0"
    end_paragraph()
    body = "".join(out)
    # two \u escapes may hold the halves of one character
    return body.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def read_rtf(data: bytes, stem: str) -> dict:
    if not data.lstrip().startswith(b"{\\rtf"):
        raise ValueError("not an RTF text")
    return B.single(stem, [], rtf_html(data.decode("utf-8", "replace")))
