"""Elements, text nodes and titles of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SILENT = {"script", "style", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTROLS = {"button", "input", "select", "textarea", "summary"}
LANDMARKS = {"nav", "main", "header", "footer", "aside", "section", "form", "article", "fieldset"}
MEDIA = {"img", "svg", "canvas", "video", "object", "embed", "iframe"}
# fixed: roles that make an element a control or a landmark, and the roles of tags without one
CONTROL_ROLES = {"button", "checkbox", "combobox", "link", "menuitem", "menuitemcheckbox", "menuitemradio", "radio", "searchbox", "slider", "spinbutton", "switch", "tab", "textbox", "treeitem", "option"}
LANDMARK_ROLES = {"banner", "complementary", "contentinfo", "form", "main", "navigation", "region", "search"}
TAG_ROLES = {"a": "link", "button": "button", "select": "combobox", "textarea": "textbox", "img": "img", "nav": "navigation", "main": "main", "header": "banner", "footer": "contentinfo", "aside": "complementary", "form": "form", "article": "article", "section": "region"}
INPUT_ROLES = {"checkbox": "checkbox", "radio": "radio", "range": "slider", "number": "spinbutton", "search": "searchbox", "button": "button", "submit": "button", "reset": "button", "image": "button"}
MAX_ELEMENTS, MAX_TEXTS, MAX_CHARS, MAX_DEPTH = 400, 300, 400, 8
_FIELDS = {"id": "int", "tag": "string", "kind": "string", "role": "string", "type": "string", "autocomplete": "string", "placeholder": "string", "target": "string", "group": "string", "name": "string", "path": "string", "hidden": "boolean", "focusable": "boolean", "disabled": "boolean", "checked": "boolean"}
_TEXT_FIELDS = {"id": "int", "text": "string", "owner": "int"}
_KINDS = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _kind(tag: str, at: dict) -> str | None:
    """interactive, media or landmark, by tag, role and attributes; text leaves are found when their element ends."""
    index = (at.get("tabindex") or "").strip()
    if (tag == "a" and "href" in at) or (tag == "input" and (at.get("type") or "text").lower() != "hidden") or tag in CONTROLS - {"input"} or at.get("role") in CONTROL_ROLES or "onclick" in at or index.isdigit() or at.get("contenteditable") in ("", "true"):
        return "interactive"
    return "media" if tag in MEDIA else "landmark" if tag in LANDMARKS or at.get("role") in LANDMARK_ROLES else None


class _Node:
    """An open element: its tag and attributes, path from the body, texts inside it, numbers of its children by tag."""

    def __init__(self, tag: str, at: dict, parent: _Node | None):
        self.tag, self.at, self.parent = tag, at, parent
        self.children: dict[str, int] = {}
        self.texts: list[str] = []
        self.row: int | None = None
        self.hidden = bool(parent and parent.hidden) or "hidden" in at or at.get("aria-hidden") == "true" or (tag == "input" and at.get("type") == "hidden")
        # what its element is inside of: parents are the open elements
        self.silent = tag in SILENT or bool(parent and parent.silent)
        self.in_head = tag == "head" or bool(parent and parent.in_head)
        self.owner: int | None = parent.owner if parent else None
        self.label: _Node | None = parent and (parent if parent.tag == "label" else parent.label)
        self.marks: tuple[str, ...] = parent.marks if parent else ()
        if tag in LANDMARKS or at.get("role") in LANDMARK_ROLES:
            self.marks = (*self.marks, tag)[-MAX_DEPTH:]
        self.path = ""
        if parent and tag not in ("html", "head", "body"):
            nth = parent.children[tag] = parent.children.get(tag, 0) + 1
            step = f"{tag}#{at['id']}" if at.get("id") else tag if nth == 1 else f"{tag}:nth-of-type({nth})"
            self.path = f"{parent.path} > {step}" if parent.path else step


class _Walk(HTMLParser):
    """Document order: elements worth showing with path, role, name and state, and texts with the element that holds them."""

    def __init__(self, hidden: bool):
        super().__init__(convert_charrefs=True)
        self.keep_hidden = hidden
        self.root = _Node("", {}, None)
        self.open = [self.root]
        self.elements: list[dict] = []
        self.nodes: list[_Node] = []
        self.texts: list[dict] = []
        self.labels: dict[str, _Node] = {}
        self.ids: dict[str, _Node] = {}
        self.cut = False
        self.title: str | None = None

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        node = _Node(tag, at, self.open[-1])
        if at.get("id"):
            self.ids.setdefault(at["id"], node)
        if tag == "label" and at.get("for"):
            self.labels.setdefault(at["for"], node)
        kind = _kind(tag, at)
        if kind and (self.keep_hidden or not node.hidden):
            self._add(node, kind)
        if tag not in VOID:
            self.open.append(node)

    def _add(self, node: _Node, kind: str):
        if len(self.elements) >= MAX_ELEMENTS:
            self.cut = True
            return
        node.row = node.owner = len(self.elements)
        at = node.at
        role = at.get("role") or (INPUT_ROLES.get((at.get("type") or "text").lower(), "textbox") if node.tag == "input" else TAG_ROLES.get(node.tag, node.tag))
        disabled = "disabled" in at or at.get("aria-disabled") == "true"
        index = (at.get("tabindex") or "").strip()
        focusable = not disabled and (kind == "interactive" and not index.startswith("-"))
        checked = "checked" in at or at.get("aria-checked") == "true" if role in ("checkbox", "radio", "switch") else None
        self.elements.append({"id": node.row, "tag": node.tag, "kind": kind, "role": role, "type": at.get("type"), "autocomplete": at.get("autocomplete"), "placeholder": at.get("placeholder"), "target": at.get("href") or at.get("src"), "group": "/".join(node.parent.marks), "path": node.path, "hidden": node.hidden, "focusable": focusable, "disabled": disabled, "checked": checked})
        self.nodes.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        text = " ".join(data.split())
        if self.open[-1].tag == "title" and self.title is None:
            self.title = text
        inner = self.open[-1]
        if not text or inner.silent:
            return
        for n in self.open:
            if len(n.texts) < MAX_CHARS:
                n.texts.append(text)
        if len(self.texts) < MAX_TEXTS and not inner.in_head:
            self.texts.append({"id": len(self.texts), "text": text[:MAX_CHARS], "owner": inner.owner})

    def name_of(self, node: _Node) -> str:
        """A name by the first that is there: its own label, what labels it, the label around it, placeholder, title, alternative text, text."""
        at, said = node.at, lambda n: " ".join(n.texts)
        by = " ".join(said(self.ids[i]) for i in (at.get("aria-labelledby") or "").split() if i in self.ids)
        label = self.labels.get(at.get("id") or "") or node.label
        every = [at.get("aria-label"), by, said(label) if label else "", at.get("placeholder") if node.tag in ("input", "textarea") else "", at.get("title"), at.get("alt"), said(node) if _kind(node.tag, at) == "interactive" else ""]
        return next((x.strip()[:MAX_CHARS] for x in every if x and x.strip()), "")

    def done(self) -> tuple[list[dict], list[dict], bool]:
        for row, node in zip(self.elements, self.nodes, strict=True):
            row["name"] = self.name_of(node)
        return self.elements, self.texts, self.cut


def walk(pages: DataFrame, key: str = "page_id", html_col: str = "html", hidden: bool = False) -> DataFrame:
    """(key, elements, texts, truncated) of pages, Arrow batch by Arrow batch; hidden: elements that aren't shown, too. Null pages have nothing."""

    def run(batches):
        structs = [pa.struct([(n, _KINDS[t]) for n, t in f.items()]) for f in (_FIELDS, _TEXT_FIELDS)]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = []
                for html in part.column(1).to_pylist():
                    w = _Walk(hidden)
                    w.feed(html or "")
                    w.close()
                    found.append(w.done())
                lists = [pa.array([f[k] for f in found], pa.list_(structs[k])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, pa.array([f[2] for f in found])], names=[key, "elements", "texts", "truncated"])

    kind = pages.schema[key].dataType.simpleString()
    shape = lambda f: ",".join(f"`{n}`:{t}" for n, t in f.items())
    return pages.select(key, html_col).mapInArrow(run, f"{key} {kind}, elements array<struct<{shape(_FIELDS)}>>, texts array<struct<{shape(_TEXT_FIELDS)}>>, truncated boolean")


def titles(pages: DataFrame, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """(key, title, n_links) by patterns alone."""
    return pages.select(key, F.regexp_extract(html_col, "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_count(html_col, F.lit("<a [^>]*href=")).cast("long").alias("n_links"))
