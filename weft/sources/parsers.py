"""Importers of single files (S01-S30): bytes to entities with components and references.

Each parser takes (path, bytes) and yields (entity_type, {component type: value}, [references]). They
run inside mapInPandas over the binaryFile source, so files are parsed where they are read."""

from __future__ import annotations

import email
import email.policy
import hashlib
import html
import io
import json
import posixpath
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from weft.sources.refs import LINK, MENTION, WIKI

Parsed = Iterator[tuple[str, dict, list[tuple[str, str]]]]


class Unsupported(ValueError):
    """A format that cannot be read; the message says what to do instead."""


def _text(raw: bytes) -> str:
    return raw.decode("utf-8-sig", "replace")


def _stem(path: str) -> str:
    name = posixpath.basename(path)
    return name.rsplit(".", 1)[0] if "." in name[1:] else name


def md_refs(text: str) -> list[tuple[str, str]]:
    out = []
    for _, target in re.findall(LINK, text):
        if re.match("https?://", target):
            out.append(("url", target))
        elif "#" in target:
            out.append(("section", target))
        elif target.endswith(".md"):
            out.append(("file", target))
    return out + [("wikilink", t) for t in re.findall(WIKI, text)] + [("mention", t) for t in re.findall(MENTION, text)]


def front(text: str) -> tuple[dict, str]:
    """YAML front matter that is a mapping, and the body; else the whole text."""
    s = text.lstrip()
    if s.startswith("---"):
        end = s.find("\n---", 3)
        if end >= 0:
            import yaml

            try:
                meta = yaml.safe_load(s[3:end])
            except yaml.YAMLError:
                meta = None
            if isinstance(meta, dict):
                return {k: v for k, v in meta.items() if isinstance(k, str)}, s[end + 4 :].lstrip("-").lstrip("\r\n")
    return {}, text


def markdown(path: str, raw: bytes) -> Parsed:
    text = _text(raw)
    meta, body = front(text)
    heading = next((x.strip()[2:].strip() for x in body.splitlines() if x.strip().startswith("# ") and x.strip()[2:].strip()), None)
    parts = {"Title": str(meta.get("title") or heading or _stem(path)), "Content": body, "Language": str(meta.get("language") or meta.get("lang") or "en"), "Provenance": {"source": path, "format": "markdown"}}
    tags = meta.get("tags")
    if tags:
        parts["Tags"] = [str(t) for t in tags] if isinstance(tags, list) else [t.strip() for t in str(tags).split(",") if t.strip()]
    if meta.get("author"):
        parts["Author"] = str(meta["author"])
    if meta.get("date") or meta.get("created_at"):
        parts["Timeline"] = {"created_at": str(meta.get("created_at") or meta.get("date"))}
    yield str(meta.get("type") or "Article"), parts, md_refs(body)


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta, self.links, self.out, self.lang = {}, [], [], None
        self.title, self.h1, self.at, self.hidden = "", "", [], 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self.at.append(tag)
        if tag == "html":
            self.lang = a.get("lang")
        if tag == "meta":
            self.meta.setdefault((a.get("name") or a.get("property") or "").lower(), a.get("content", ""))
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        self.hidden += tag in ("script", "style")
        if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.at:
            while self.at and self.at.pop() != tag:
                pass
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if "title" in self.at:
            self.title += data
        elif not self.hidden:
            if "h1" in self.at:
                self.h1 += data
            self.out.append(data)


def html_page(path: str, raw: bytes) -> Parsed:
    """S05, X04."""
    p = _Page()
    p.feed(_text(raw))
    body = re.sub(r"[ \t]+", " ", re.sub(r"\s*\n\s*", "\n", "".join(p.out))).strip()
    parts = {"Title": p.title.strip() or p.h1.strip() or _stem(path), "Content": body, "Language": p.lang or "en", "Provenance": {"source": path, "format": "html"}}
    if author := p.meta.get("author") or p.meta.get("dc.creator"):
        parts["Author"] = author
    if about := p.meta.get("description") or p.meta.get("og:description"):
        parts["Description"] = about
    if tags := [t.strip() for t in p.meta.get("keywords", "").split(",") if t.strip()]:
        parts["Tags"] = tags
    refs = []
    for h in p.links:
        if re.match("https?://", h):
            refs.append(("url", h))
        elif not h.startswith(("mailto:", "#")):
            refs.append(("section" if "#" in h else "file", h))
    yield "Article", parts, refs


def _plain(kind: str, read: Callable[[bytes], str]) -> Callable[[str, bytes], Parsed]:
    def run(path: str, raw: bytes) -> Parsed:
        yield "Article", {"Title": _stem(path), "Content": read(raw), "Provenance": {"source": path, "format": kind}}, []

    return run


def _xml_lines(raw: bytes) -> str:
    """<tag>, text and a blank, </tag> and a line end."""
    out: list[str] = []

    def walk(e):
        tag = e.tag.rpartition("}")[2]
        out.append(f"<{tag}>")
        if (e.text or "").strip():
            out.append(e.text.strip() + " ")
        for c in e:
            walk(c)
            if (c.tail or "").strip():
                out.append(c.tail.strip() + " ")
        out.append(f"</{tag}>\n")

    walk(ElementTree.fromstring(raw))
    return "".join(out)


def _yaml(raw: bytes) -> str:
    import yaml

    return json.dumps(yaml.safe_load(_text(raw)), ensure_ascii=False, default=str)


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def _zip(raw: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(raw))


def _docx(raw: bytes) -> str:
    """A line per run."""
    root = ElementTree.fromstring(_zip(raw).read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in r.iter() if _local(t) == "t") for r in root.iter() if _local(r) == "r")


def _xlsx(raw: bytes) -> str:
    """The first sheet, cells joined by tabs."""
    z = _zip(raw)
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si) == "si"]
    sheet = _first_sheet(z)
    rows: dict[int, list] = {}
    for row in (r for r in ElementTree.fromstring(z.read(sheet)).iter() if _local(r) == "row"):
        cells: list[str] = []
        for c in (c for c in row if _local(c) == "c"):
            v = "".join(x.text or "" for x in c.iter() if _local(x) in ("v", "t"))
            place = _column(c.get("r"))
            cells += [""] * (place - len(cells)) if place is not None else []
            cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
        rows[int(row.get("r") or len(rows) + 1)] = cells
    return "\n".join("\t".join(rows[k]) for k in sorted(rows))


def _column(ref: str | None) -> int | None:
    """Place of a cell from 0 by the letters of its reference."""
    n = 0
    for ch in re.match(r"[A-Z]*", ref or "")[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1 if n else None


def _first_sheet(z: zipfile.ZipFile) -> str:
    """The file of the workbook's first sheet; without a workbook the first by number."""
    names = z.namelist()
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        first = next((e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e) == "sheet"), None)
        ident = next((v for k, v in first.attrib.items() if k.endswith("}id")), None) if first is not None else None
        for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            if r.get("Id") == ident:
                target = r.get("Target", "")
                path = target.lstrip("/") if target.startswith("/") else "xl/" + target
                if path in names:
                    return path
    number = lambda n: int((re.search(r"(\d+)\.xml$", n) or [0, 0])[1])
    return min((n for n in names if n.startswith("xl/worksheets/sheet")), key=number)


def _pptx(raw: bytes) -> str:
    """S16."""
    z = _zip(raw)
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    out = []
    for n in sorted((n for n in z.namelist() if re.match(r"ppt/slides/slide\d+\.xml$", n)), key=number):
        texts = [t.text for t in ElementTree.fromstring(z.read(n)).iter() if _local(t) == "t" and t.text]
        out.append(f"--- Slide {number(n)} ---\n" + "\n".join(texts))
    return "\n".join(out)


def _odf(raw: bytes) -> str:
    """Paragraphs and headings; tables as cells and rows."""
    root = ElementTree.fromstring(_zip(raw).read("content.xml"))
    rows = [r for r in root.iter() if _local(r) == "table-row"]
    if rows:
        return "\n".join("\t".join("".join(c.itertext()) for c in r if _local(c) == "table-cell") for r in rows)
    return "\n".join("".join(e.itertext()) for e in root.iter() if _local(e) in ("p", "h"))


def _iwork(raw: bytes) -> str:
    """The XML form; the binary one gives its printable runs."""
    z = _zip(raw)
    if "index.xml" in z.namelist():
        return "\n".join("".join(e.itertext()) for e in ElementTree.fromstring(z.read("index.xml")).iter() if _local(e) in ("p", "span"))
    if "Index/Document.iwa" in z.namelist():
        return "\n".join(x.decode() for x in re.findall(rb"[\x20-\x7e]{4,}", z.read("Index/Document.iwa")))
    raise Unsupported("neither index.xml nor Index/Document.iwa")


def _refuse(hint: str) -> Callable[[str, bytes], Parsed]:
    def run(path: str, raw: bytes) -> Parsed:
        raise Unsupported(hint)
        yield

    return run


def _message(path: str, raw: bytes) -> tuple[str, dict, list]:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    part = m
    while part.is_multipart() and part.get_payload():
        part = part.get_payload()[0]
    try:
        body = part.get_content()
    except (LookupError, KeyError):
        body = part.get_payload(decode=True) or b""
    body = body if isinstance(body, str) else bytes(body).decode("utf-8", "replace")
    parts = {"Title": str(m["subject"] or _stem(path)), "Content": body, "Provenance": {"source": path, "format": "email"}}
    if m["from"]:
        parts["Author"] = str(m["from"])
    if m["date"]:
        parts["Timeline"] = {"created_at": str(m["date"])}
    return "Email", parts, []


def eml(path: str, raw: bytes) -> Parsed:
    """S20."""
    yield _message(path, raw)


def mbox(path: str, raw: bytes) -> Parsed:
    """One message per envelope line, without that line."""
    for m in re.split(rb"(?:^|\r?\n)(?=From [^\n]*\n)", raw):
        if m.strip():
            yield _message(path, re.sub(rb"^From [^\n]*\n", b"", m))


def _field(block: str, name: str) -> str | None:
    m = re.search(rf"(?m)^\s*{name}(?:;[^:\n]*)?:(.*?)\r?$", block)
    return m[1].strip() if m and m[1].strip() else None


def ics(path: str, raw: bytes) -> Parsed:
    """S22."""
    for block in _text(raw).split("BEGIN:VEVENT")[1:]:
        parts = {"Title": _field(block, "SUMMARY") or "Untitled", "Provenance": {"source": path, "format": "ics"}}
        if text := _field(block, "DESCRIPTION"):
            parts["Content"] = text
        if start := _field(block, "DTSTART"):
            parts["Timeline"] = {"created_at": start, "end": _field(block, "DTEND")}
        yield "Event", parts, []


def vcf(path: str, raw: bytes) -> Parsed:
    """S23."""
    for block in _text(raw).split("BEGIN:VCARD")[1:]:
        body = {k: v for k, n in (("email", "EMAIL"), ("phone", "TEL"), ("organization", "ORG")) if (v := _field(block, n))}
        yield "Person", {"Title": _field(block, "FN") or _field(block, "N") or "Untitled", "Content": body, "Provenance": {"source": path, "format": "vcf"}}, []


def enex(path: str, raw: bytes) -> Parsed:
    """S24."""
    notes = [n for n in ElementTree.fromstring(raw).iter() if _local(n) == "note"]
    if not notes:
        raise Unsupported("no note in it")
    for n in notes:
        get = lambda k, n=n: [c.text or "" for c in n if _local(c) == k]
        text = html.unescape(re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", (get("content") or [""])[0]))).strip()
        parts = {"Title": (get("title") or ["Untitled"])[0], "Content": text, "Provenance": {"source": path, "format": "enex"}}
        if get("tag"):
            parts["Tags"] = get("tag")
        yield "Note", parts, []


def opml(path: str, raw: bytes) -> Parsed:
    """Every outline with a text, parents too."""
    for o in ElementTree.fromstring(raw).iter():
        if _local(o) == "outline" and (o.get("text") or o.get("title")):
            parts = {"Title": o.get("text") or o.get("title"), "Provenance": {"source": path, "format": "opml"}}
            if o.get("_note"):
                parts["Content"] = o.get("_note")
            yield "Article", parts, [("url", o.get("xmlUrl"))] if o.get("xmlUrl") else []


def json_file(path: str, raw: bytes) -> Parsed:
    """S10; S26 where the stem names notion: its first page."""
    value = json.loads(_text(raw))
    if "notion" in _stem(path).lower():
        pages = value.get("results", [value]) if isinstance(value, dict) else value
        page = pages[0] if pages else {}
        title = page.get("properties", {}).get("title", {})
        title = title.get("title", [{}])[0].get("plain_text") if isinstance(title, dict) and title.get("title") else None
        yield "Page", {"Title": title or page.get("id") or "Untitled", "Content": json.dumps(page, ensure_ascii=False), "Provenance": {"source": path, "format": "notion"}}, []
    else:
        yield "Article", {"Title": _stem(path), "Content": json.dumps(value, separators=(",", ":"), ensure_ascii=False), "Provenance": {"source": path, "format": "json"}}, []


def image(path: str, raw: bytes, recognise: Callable[[bytes], tuple[str, float]] | None = None) -> Parsed:
    """The image's facts and, with a recogniser (bytes to text and confidence), its text."""
    kind = path.rsplit(".", 1)[-1].lower().replace("jpg", "jpeg")
    parts = {"Title": _stem(path), "BinaryContent": {"reference": path, "mime": f"image/{kind}", "size": len(raw)}, "Provenance": {"source": path, "format": "image"}}
    if recognise is not None:
        text, confidence = recognise(raw)
        if text.strip():
            parts["Content"] = text
            parts["Provenance"]["confidence"] = confidence
    yield "Image", parts, []


_LITERAL = rb"\(((?:[^()\\]|\\.)*)\)"
_BARE = rb"\((?:[^()\\]|\\.)*\)"
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    """A literal string: escapes and octal codes resolved; UTF-16 if it says so."""

    def one(m: re.Match) -> bytes:
        e = m[1]
        return bytes([int(e, 8) & 255]) if e[:1].isdigit() else _ESCAPES.get(e, b"" if e in b"\r\n" else e)

    plain = re.sub(rb"\\([0-7]{1,3}|.)", one, raw, flags=re.S)
    return plain[2:].decode("utf-16-be", "replace") if plain[:2] == b"\xfe\xff" else plain.decode("latin-1")


def _pdf_streams(raw: bytes) -> Iterator[bytes]:
    """The streams of a file, deflated ones unpacked; of other filters none."""
    for m in re.finditer(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(.*?)\r?\nendstream", raw, re.S):
        if b"/FlateDecode" in m[1]:
            try:
                yield zlib.decompressobj().decompress(m[2])
            except zlib.error:
                continue
        elif b"/Filter" not in m[1]:
            yield m[2]


def pdf(path: str, raw: bytes) -> Parsed:
    """Metadata and the text shown by plain and deflated streams, a line for each operator; without text no Content."""
    parts = {"Title": _stem(path), "BinaryContent": {"reference": path, "mime": "application/pdf", "size": len(raw)}, "Language": "en", "Provenance": {"source": path, "format": "pdf"}}
    if t := re.search(rb"<dc:title>.*?<rdf:li[^>]*>(.*?)</rdf:li>", raw, re.S):
        parts["Title"] = t[1].decode("utf-8", "replace")
    elif t := re.search(rb"/Title\s*" + _LITERAL, raw):
        parts["Title"] = _pdf_string(t[1])
    shown = []
    for stream in [*_pdf_streams(raw)] or [raw]:
        for m in re.finditer(_LITERAL + rb"\s*(?:Tj|'|\")|\[((?:[^\[\]()]|" + _BARE + rb")*)\]\s*TJ", stream, re.S):
            if m[1] is not None:
                shown.append(_pdf_string(m[1]))
            else:
                shown.append("".join(_pdf_string(x) for x in re.findall(_LITERAL, m[2])))
    if any(x.strip() for x in shown):
        parts["Content"] = "\n".join(shown)
    yield "Article", parts, []


def clipboard(text: str, is_html: bool = False) -> tuple[str, dict, list]:
    """S30."""
    body = next(html_page("clip.html", text.encode()))[1]["Content"] if is_html else text
    return "Note", {"Title": "Clipboard Content", "Content": body}, []


def url_page(url: str, content_type: str, raw: bytes) -> Parsed:
    """S29 after the fetch: by content type."""
    if "pdf" in content_type:
        return pdf(url, raw)
    return html_page(url, raw) if "html" in content_type else _plain("text", _text)(url, raw)


_ODF = ("odt", "ods", "odp", "odg", "ott", "ots", "otp")
PARSERS: dict[str, Callable[[str, bytes], Parsed]] = {
    "md": markdown, "html": html_page, "htm": html_page, "json": json_file, "xml": _plain("xml", _xml_lines), "yaml": _plain("yaml", _yaml), "yml": _plain("yaml", _yaml),
    "txt": _plain("text", _text), "docx": _plain("docx", _docx), "xlsx": _plain("xlsx", _xlsx), "xlsm": _plain("xlsm", _xlsx), "pptx": _plain("pptx", _pptx), "pdf": pdf,
    "eml": eml, "mbox": mbox, "ics": ics, "vcf": vcf, "enex": enex, "opml": opml,
    **{e: _plain(e, _odf) for e in _ODF}, **{e: _plain(e, _iwork) for e in ("pages", "numbers", "key")},
    **{e: image for e in ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff")},
    **{e: _refuse(f"save the .{e} file as .{e}x") for e in ("doc", "ppt", "pps", "xls")}, "msg": _refuse("save the message as .eml"),
}

_OUT = "path string, entity_id string, entity_type string, components array<struct<component_type:string,data:string>>, refs array<struct<kind:string,target:string>>, content_hash string, error string"


def detect(path: str, raw: bytes, parsers: dict) -> str | None:
    """By extension, then by the first bytes."""
    ext = posixpath.basename(path).rpartition(".")[2].lower()
    if ext in parsers:
        return ext
    if raw[:4] == b"%PDF":
        return "pdf"
    if raw[:4] == b"PK\x03\x04":
        return next((k for part, k in ((b"word/", "docx"), (b"xl/", "xlsx"), (b"ppt/", "pptx")) if part in raw[:4096]), None)
    return None


def imported(files: DataFrame, parsers: dict | None = None) -> DataFrame:
    """A row per entity found in files (path, content): its components and references, or
    the error that kept a file out. Ids are hashes of path and place, so a second import gives the same."""
    table = parsers or PARSERS

    def run(batches):
        for b in batches:
            out = []
            for path, raw in zip(b["path"], b["content"], strict=True):
                raw = bytes(raw)
                digest = hashlib.sha256(raw).hexdigest()
                kind = detect(path, raw, table)
                try:
                    found = list(table[kind](path, raw)) if kind else []
                    error = None if kind else "unknown format"
                except Exception as e:  # noqa: BLE001 - a bad file is a row, not a failed job
                    found, error = [], f"{type(e).__name__}: {e}"[:300]
                if error:
                    out.append((path, None, None, [], [], digest, error))
                for k, (etype, parts, refs) in enumerate(found):
                    ident = hashlib.sha256(f"{path}#{k}".encode()).hexdigest()
                    comps = [{"component_type": c, "data": json.dumps(v, ensure_ascii=False)} for c, v in parts.items()]
                    out.append((path, ident, etype, comps, [{"kind": a, "target": t} for a, t in dict.fromkeys(refs)], digest, None))
            yield pd.DataFrame(out, columns=["path", "entity_id", "entity_type", "components", "refs", "content_hash", "error"])

    return files.select("path", "content").mapInPandas(run, _OUT)
