"""Chunks, symbols and imports of one source file, from its shallow syntax tree."""

from __future__ import annotations

import re

from ..operators.chunking import MAX_CHARS, pack_lines
from .nodes import Node, Source

# Node kinds that become chunks and symbols, and those that are imports, by language.
_SCRIPT = ("function_declaration", "class_declaration", "export_statement", "lexical_declaration")
_TYPED = (*_SCRIPT, "interface_declaration", "type_alias_declaration", "enum_declaration")
DEFINITIONS = {
    "Python": ("function_definition", "class_definition", "decorated_definition"),
    "JavaScript": _SCRIPT, "TypeScript": _TYPED, "Tsx": _TYPED,
    "Rust": ("function_item", "struct_item", "enum_item", "impl_item", "trait_item", "mod_item", "type_item"),
    "Go": ("function_declaration", "method_declaration", "type_declaration"),
    "Java": ("method_declaration", "class_declaration", "interface_declaration"),
    "C": ("function_definition", "struct_specifier"),
    "Cpp": ("function_definition", "struct_specifier", "class_specifier"),
}
IMPORTS = {
    "Python": ("import_statement", "import_from_statement"),
    "JavaScript": ("import_statement",), "TypeScript": ("import_statement",), "Tsx": ("import_statement",),
    "Rust": ("use_declaration", "extern_crate_declaration"),
    "Go": ("import_declaration",), "Java": ("import_declaration",), "C": ("preproc_include",), "Cpp": ("preproc_include",),
}
_FUNCTIONS = ("function_definition", "function_declaration", "function_item", "method_declaration")
_TYPES = (
    "class_definition", "class_declaration", "interface_declaration", "type_alias_declaration", "enum_declaration", "struct_item", "enum_item", "trait_item", "type_item", "impl_item",
    "type_declaration", "struct_specifier", "class_specifier",
)
_SYMBOLS = {
    "function_definition": "function", "function_declaration": "function", "function_item": "function", "method_declaration": "method", "class_definition": "class", "class_declaration": "class",
    "interface_declaration": "interface", "type_alias_declaration": "type_alias", "enum_declaration": "enum", "struct_item": "struct", "enum_item": "enum", "trait_item": "trait",
    "impl_item": "impl_block", "type_item": "type_alias", "mod_item": "module", "type_declaration": "type_alias", "struct_specifier": "struct", "class_specifier": "class",
}
_COMMENTS = ("comment", "line_comment", "block_comment")
_INNER = ("function_definition", "function_item", "method_declaration", "method_definition")
_NESTING = ("class", "struct", "impl_block", "trait", "interface")
DOC_CHARS = 500


def chunk_kind(node: Node) -> str:
    kind = node.inner.kind if node.kind == "decorated_definition" and node.inner else node.kind
    return "Function" if kind in _FUNCTIONS else "TypeHeader" if kind in _TYPES else "Declaration"


def symbol_kind(kind: str) -> str:
    return _SYMBOLS.get(kind, "declaration")


def _name(node: Node, lang: str) -> str:
    """The name field; C functions and Go types have none, a Rust impl has its type."""
    if lang in ("C", "Cpp") and node.kind == "function_definition" or lang == "Go" and node.kind == "type_declaration":
        return ""
    return node.name or (node.type if node.kind == "impl_item" else "")


def _size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


class File:
    def __init__(self, text: str, lang: str, limit: int = MAX_CHARS):
        self.text, self.lang, self.limit = text, lang, limit
        self.source = Source(text, lang)
        self.nodes = self.source.root()

    def line(self, offset: int) -> int:
        return self.text.count("\n", 0, min(offset, len(self.text))) + 1

    def span(self, a: int, b: int) -> str:
        return self.text[a:b]

    # chunks
    def chunks(self) -> list[tuple]:
        """(text, kind, symbol_name, parent_context, line_start, line_end); none if nothing at the root is a definition, import or preamble."""
        out: list[tuple] = []
        imports: list[Node] = []
        preamble, header = 0, True
        for n in self.nodes:
            if n.kind in IMPORTS[self.lang]:
                if header:
                    imports.append(n)
                continue
            first = not out and not imports
            if n.kind in _COMMENTS:
                preamble = n.end if first else preamble
                continue
            if self.lang == "Python" and n.kind == "expression_statement" and n.type == "string" and first:
                preamble = n.end
                continue
            header = False
            if n.kind in DEFINITIONS[self.lang]:
                out += self.definition(n)
        front = []
        lead = self.span(0, preamble).strip()
        if preamble and lead:
            front += self.packed(lead, "Preamble", 1, self.line(preamble))
        if imports:
            a, b = imports[0].start, imports[-1].end
            front += self.packed(self.span(a, b), "ImportBlock", self.line(a), self.line(b))
        return front + out

    def packed(self, text: str, kind: str, first: int, last: int) -> list[tuple]:
        if _size(text) <= self.limit:
            return [(text, kind, "", "", first, last)]
        return [(t, kind, "", "", a, b) for t, a, b in pack_lines(text, self.limit, first)]

    def definition(self, n: Node) -> list[tuple]:
        text, first = self.span(n.start, n.end), self.line(n.start)
        name = _name(n, self.lang)
        if n.kind == "decorated_definition" and n.inner:
            name = n.inner.name
        if _size(text) <= self.limit:
            return [(text, chunk_kind(n), name, "", first, self.line(n.end))]
        parts = self.large(n)
        return parts or [(t, "TextWindow", name, "", a, b) for t, a, b in pack_lines(text, self.limit, first)]

    def large(self, n: Node) -> list[tuple]:
        """Head and inner definitions of a definition above the limit; nothing where it has no body."""
        if n.body is None or n.kind in ("decorated_definition", "export_statement", "lexical_declaration"):
            return []
        name = n.name or n.type
        context = f"{n.kind} {name if _name(n, self.lang) else ''}".strip()
        out = []
        head = self.span(n.start, n.body[0])
        if head.strip():
            out.append((head.rstrip(), "TypeHeader", _name(n, self.lang), "", self.line(n.start), self.line(n.body[0])))
        for c in self.source.body_of(n):
            if c.kind not in DEFINITIONS[self.lang] and c.kind not in _INNER:
                continue
            text, first, inner = self.span(c.start, c.end), self.line(c.start), "" if self.lang in ("C", "Cpp") and c.kind == "function_definition" else c.name
            if _size(text) <= self.limit:
                out.append((text, "Method", inner, context, first, self.line(c.end)))
            else:
                out += [(t, "TextWindow", inner, context, a, b) for t, a, b in pack_lines(text, self.limit, first)]
        return out

    # symbols
    def symbols(self) -> list[tuple]:
        """(name, qualified_name, kind, line_start, line_end, signature, doc_comment, visibility, parent_name)."""
        out: list[tuple] = []
        self._symbols(self.nodes, "", out)
        return out

    def _symbols(self, nodes: list[Node], parent: str, out: list) -> None:
        for k, n in enumerate(nodes):
            if n.kind not in DEFINITIONS[self.lang]:
                continue
            name, kind = _name(n, self.lang), n.kind
            if n.kind in ("export_statement", "lexical_declaration"):
                name = ""
            if n.kind == "decorated_definition":
                name, kind = (n.inner.name, n.inner.kind) if n.inner else ("", "")
            if not name:
                continue
            text = self.span(n.start, n.end)
            what = symbol_kind(kind)
            out.append((name, f"{parent}.{name}" if parent else name, what, self.line(n.start), self.line(n.end), signature(text), self.doc(nodes, k), self.visibility(n, text), parent))
            if what in _NESTING and n.kind != "decorated_definition":
                self._symbols(self.source.body_of(n), name, out)

    def doc(self, nodes: list[Node], k: int) -> str:
        return self.span(nodes[k - 1].start, nodes[k - 1].end)[:DOC_CHARS] if k and nodes[k - 1].kind in _COMMENTS else ""

    def visibility(self, n: Node, text: str) -> str:
        if self.lang == "Rust":
            return n.visibility
        if self.lang == "Java":
            return next((v for v in ("public", "private", "protected") if v in n.modifiers), "")
        if self.lang in ("TypeScript", "Tsx"):
            return "export" if text.split("\n", 1)[0].startswith("export ") else ""
        return ""

    # imports
    def imports(self) -> list[tuple]:
        """(import_kind, raw_specifier, imported_names, line_number)."""
        out: list[tuple] = []
        read = {"Python": _python_import, "Rust": _rust_import, "Go": _go_import, "Java": _java_import, "C": _c_include, "Cpp": _c_include}.get(self.lang, _script_import)
        for n in self.nodes:
            text = self.span(n.start, n.end)
            if n.kind in IMPORTS[self.lang]:
                out += [(*x, self.line(n.start)) for x in read(text, n.kind)]
            elif n.kind == "export_statement":
                m = re.match(r"export\s+(?:type\s+)?\{[^}]*\}\s*from\s*(['\"])(.*?)\1", text)
                if m and m[2]:
                    out.append(("reexport", m[2], [], self.line(n.start)))
        return out


def signature(text: str) -> str:
    brace, colon = text.find("{"), text.find(":")
    if brace >= 0:
        return text[:brace].strip()
    return text[: colon + 1].strip() if colon >= 0 else text.split("\n", 1)[0].strip()


def _bare(text: str) -> str:
    return re.sub(r"/\*.*?\*/|//[^\n]*", " ", text, flags=re.S)


def _python_import(text: str, kind: str):
    t = re.sub(r"#[^\n]*|\\\n", " ", text)
    if kind == "import_statement":
        parts = [p.strip() for p in t.strip()[len("import") :].split(",")]
        return [("module", re.sub(r"\s*\.\s*", ".", p), []) for p in parts if p and not re.search(r"\sas\s", p)]
    m = re.match(r"from\s*(\.*)\s*([\w.]*)\s*import\s*\(?(.*?)\)?\s*$", t.strip(), re.S)
    if not m:
        return []
    dots, module, names = m[1], m[2], m[3]
    module = dots + (dots + module if dots else module)
    if names.strip() == "*":
        return [("wildcard", module, [])]
    got = [n for n in (re.split(r"\s+as\s+", p.strip())[0].strip() for p in names.split(",")) if n and n != module]
    return [("named" if got else "module", module, got)] if module else []


def _script_import(text: str, kind: str):
    t = _bare(text)
    m = re.search(r"(['\"])((?:(?!\1).)*)\1\s*(?:with\s*\{.*\}\s*)?;?\s*$", t, re.S)
    if not m or not m[2]:
        return []
    clause = re.sub(r"^import\s+(?:type\s+(?!from\b|,))?", "", t[: m.start()].strip() + " ")
    clause = re.sub(r"\bfrom\s*$", "", clause.strip()).strip()
    names = []
    braces = re.search(r"\{(.*?)\}", clause, re.S)
    plain = re.sub(r"\{.*?\}|\*\s*as\s+\w+", "", clause, flags=re.S)
    names += [p.strip() for p in plain.split(",") if re.fullmatch(r"[\w$]+", p.strip())]
    if braces:
        names += [re.sub(r"^type\s+(?=\S)", "", re.split(r"\s+as\s+", p.strip())[0]).strip() for p in braces[1].split(",") if p.strip()]
    return [("named" if names else "default" if " from " in text else "side_effect", m[2], names)]


def _strip_repeated(text: str, prefix: str) -> str:
    while text.startswith(prefix):
        text = text[len(prefix) :]
    return text


# A use path with what stands in its first braces, up to a second opening one; the colons before them belong to neither.
_RUST_USE = re.compile(r"(?P<path>[^{]*?)(?:::)*(?:\{(?P<names>[^{]*).*)?", re.S)


def _rust_import(text: str, kind: str):
    if kind == "extern_crate_declaration":
        return [("module", re.sub(r"\A(?:extern crate )+", "", text).rstrip(";").strip(), [])]
    use = _RUST_USE.fullmatch(re.sub(r"\A(?:use )+", "", text).rstrip(";").strip())
    if use["names"] is not None:
        return [("named", use["path"], [n for n in map(str.strip, use["names"].rstrip("}").split(",")) if n])]
    return [("wildcard" if use[0].endswith("*") else "module", use["path"], [])]


def _go_import(text: str, kind: str):
    body = _bare(text) if "`" not in text else text
    group = re.match(r"import\s*\((.*)\)\s*$", body, re.S)
    if group:
        return [("module", m[1], []) for m in re.finditer(r"[\"`]([^\"`\n]+)[\"`]", group[1])]
    spec = re.sub(r"^import\s*", "", body.strip()).rstrip(";").strip().strip('"')
    return [("module", spec, [])] if spec else []


def _java_import(text: str, kind: str):
    spec = _strip_repeated(_strip_repeated(text, "import "), "static ").rstrip(";").strip()
    return [("wildcard" if spec.endswith(".*") else "named", spec, [])]


def _c_include(text: str, kind: str):
    spec = re.sub(r"^#\s*include\s*", "", text).strip()
    m = re.match(r"\"([^\"]*)\"|<([^>]*)>|(\S+)", spec)
    spec = next((g for g in m.groups() if g is not None), "") if m else ""
    return [("include", spec, [])] if spec else []
