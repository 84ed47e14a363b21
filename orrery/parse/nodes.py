"""A shallow syntax tree: what stands at the root of a file and in the bodies of its definitions.

Kinds carry the names of the public tree-sitter grammars, whose nodes the chunker and the
extractors are specified on; only what these consult is built: kind, extent, name, body and the
children of bodies.  A full parser can take this module's place by giving the same ``Node``s.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from . import lexers

_BLOCK_COMMENT = {"Rust", "Java"}


@dataclass
class Node:
    kind: str
    start: int
    end: int
    name: str = ""
    type: str = ""  # the type of a Rust impl
    body: tuple[int, int] | None = None
    inner: "Node | None" = None  # what is decorated
    modifiers: str = ""
    visibility: str = ""
    tokens: tuple[int, int] = (0, 0)
    inside: tuple[int, int] = field(default=(0, 0))  # tokens of the body


class Source:
    """The tokens of a file with their partners; nodes are made on demand."""

    def __init__(self, text: str, lang: str):
        self.text, self.lang = text, lang
        self.aside: list = []
        self.cls, self.off = lexers.tokens(text, lang, self.aside)
        self.partner: dict[int, int] = {}
        stack: list[int] = []
        opens = {")": "(", "]": "[", "}": "{", "}B": "{B"}
        for k, c in enumerate(self.cls):
            if c in ("(", "[", "{", "{B"):
                stack.append(k)
            elif c in opens and stack:
                if self.cls[stack[-1]] == opens[c]:
                    self.partner[stack.pop()] = k
                elif any(self.cls[s] == opens[c] for s in stack):
                    while self.cls[stack[-1]] != opens[c]:
                        self.partner[stack.pop()] = k
                    self.partner[stack.pop()] = k
        for s in stack:
            self.partner[s] = len(self.cls)

    def end(self, k: int) -> int:
        """Text offset after token k; marks that were inserted have no length."""
        while k > 0 and (self.cls[k] in ("nl", "}B", "{B") or self.cls[k] == ";" and not self.text.startswith(";", self.off[k])):
            k -= 1
        return lexers.token_end(self.text, self.lang, self.cls[k], self.off[k])

    def word(self, k: int) -> str:
        return self.text[self.off[k] : lexers.token_end(self.text, self.lang, self.cls[k], self.off[k])]

    def skip(self, k: int) -> int:
        """The token after k, over the group it opens."""
        return self.partner[k] + 1 if k in self.partner else k + 1

    def root(self) -> list[Node]:
        return self.children(0, len(self.cls), True, 0, len(self.text) + 1)

    def body_of(self, node: Node) -> list[Node]:
        if not node.body:
            return []
        return self.children(*node.inside, False, node.body[0], node.body[1], node)

    def children(self, lo: int, hi: int, top: bool, start: int, stop: int, parent: Node | None = None) -> list[Node]:
        build = {"Python": self._python, "Rust": self._rust, "Go": self._go, "Java": self._java, "C": self._c, "Cpp": self._c}.get(self.lang, self._script)
        nodes, k = [], lo
        while k < hi:
            node, nxt = build(k, hi, top, parent)
            if node is not None:
                nodes.append(node)
            k = max(nxt, k + 1)
        taken = [(n.start, n.end) for n in nodes]
        for kind, a, b in self.aside:
            if start <= a < stop and not any(x <= a < y for x, y in taken):
                if kind == "comment":
                    kind = "comment" if self.lang not in _BLOCK_COMMENT else "block_comment" if self.text.startswith("/*", a) else "line_comment"
                elif kind == "include":
                    kind = "preproc_include"
                else:
                    kind = "preproc"
                nodes.append(Node(kind, a, b))
        return sorted(nodes, key=lambda n: (n.start, n.end))

    def node(self, kind: str, a: int, b: int, **more) -> Node:
        return Node(kind, self.off[a], self.end(b), tokens=(a, b), **more)

    def find(self, k: int, hi: int, *wanted: str) -> int:
        """The first of the classes at this level, hi if none."""
        while k < hi and self.cls[k] not in wanted:
            k = self.skip(k)
        return min(k, hi)

    def bodied(self, kind: str, a: int, brace: int, hi: int, **more) -> tuple[Node, int]:
        z = min(self.partner.get(brace, hi - 1), hi - 1)
        n = self.node(kind, a, z, **more)
        n.body, n.inside = (self.off[brace], n.end), (brace + 1, z)
        return n, z + 1

    def simple(self, kind: str, a: int, hi: int) -> tuple[Node, int]:
        z = self.find(a, hi, ";")
        return self.node(kind, a, min(z, hi - 1)), z + 1

    # Python: statements are logical lines; a block follows as {B ... }B
    def _python(self, k, hi, top, parent):
        if self.cls[k] in ("nl", ";", "}B"):
            return None, k + 1
        if self.cls[k] == "{B":
            return None, self.skip(k)
        first = self.cls[k]
        if first == "@":
            z = self.find(k, hi, "nl") + 1
            inner, nxt = self._python(z, hi, top, parent) if z < hi else (None, z)
            if inner is None:
                return None, nxt
            n = Node("decorated_definition", self.off[k], inner.end, inner=inner.inner or inner, tokens=(k, inner.tokens[1]))
            return n, nxt
        if first in ("def", "class") or first == "async" and k + 1 < hi and self.cls[k + 1] == "def":
            d = k + (first == "async")
            kind = "class_definition" if self.cls[d] == "class" else "function_definition"
            name = self.word(d + 1) if d + 1 < hi and self.cls[d + 1] in ("i", "match", "case", "type") else ""
            colon = self.find(d, hi, ":", "nl")
            line = self.find(colon, hi, "nl")
            if line + 1 < hi and self.cls[line + 1] == "{B":
                z = self.partner[line + 1]
                n = self.node(kind, k, min(z, hi - 1), name=name)
                inside = (line + 2, min(z, hi))
                n.body, n.inside = (self.off[line + 2] if line + 2 < hi else n.end, n.end), inside
                return n, z + 1
            n = self.node(kind, k, min(line, hi - 1), name=name)
            if colon + 1 < line:
                n.body, n.inside = (self.off[colon + 1], n.end), (colon + 1, line)
            return n, line + 1
        line = self.find(k, hi, "nl")
        z = min(self.find(k, hi, "nl", ";"), hi - 1)
        if first == "import":
            return self.node("import_statement", k, z), z + 1
        if first == "from":
            kind = "future_import_statement" if k + 1 < hi and self.word(k + 1) == "__future__" else "import_from_statement"
            return self.node(kind, k, z), z + 1
        kind = "expression_statement" if first in ("i", "n", "s", "(", "[", "{", "-", "not", "await", "True", "False", "None", "...", "*", "~", "+") else first + "_statement"
        n = self.node(kind, k, z)
        if kind == "expression_statement" and first == "s" and all(c == "s" for c in self.cls[k:z] if c != "nl"):
            n.type = "string"
        while line + 1 < hi and self.cls[line + 1] == "{B":  # compound statements take their blocks and branches
            after = self.partner[line + 1] + 1
            n.end = max(n.end, self.end(min(after, hi) - 1))
            if after < hi and self.cls[after] in ("elif", "else", "except", "finally", "case"):
                line = self.find(after, hi, "nl")
                z = line
                continue
            return n, after
        return n, z + 1

    def _script(self, k, hi, top, parent):
        c = self.cls
        if c[k] == ";":
            return None, k + 1
        if parent is not None and parent.kind in ("class_declaration", "interface_declaration"):
            return self._script_member(k, hi, parent)
        if c[k] == "import" and k + 1 < hi and c[k + 1] not in ("(", "."):
            return self.simple("import_statement", k, hi)
        if c[k] == "export":
            j = k + 1
            while j < hi and c[j] in ("default", "async", "abstract", "declare"):
                j += 1
            if j < hi and (c[j] in ("function", "class", "interface", "enum", "namespace", "module") or c[j] == "const" and j + 1 < hi and c[j + 1] == "enum"):
                brace = self.find(j, hi, "{")
                n, nxt = self.bodied("export_statement", k, brace, hi) if brace < hi else self.simple("export_statement", k, hi)
                n.body = None
                return n, nxt
            if j < hi and c[j] == "{":
                z = self.partner[j]
                if z + 1 < hi and c[z + 1] == "from":
                    return self.simple("export_statement", k, hi)
                return self.node("export_statement", k, min(z, hi - 1)), z + 1
            return self.simple("export_statement", k, hi)
        j = k + (c[k] == "async")
        if j < hi and c[j] == "function":
            name = next((self.word(x) for x in (j + 1, j + 2) if x < hi and c[x] not in ("*", "(")), "")
            brace = self.find(j, hi, "{")
            kind = "generator_function_declaration" if j + 1 < hi and c[j + 1] == "*" else "function_declaration"
            return self.bodied(kind, k, brace, hi, name=name) if brace < hi else self.simple(kind, k, hi)
        j = k + (c[k] == "abstract")
        if j < hi and c[j] == "class":
            brace = self.find(j, hi, "{")
            if brace < hi:
                return self.bodied("abstract_class_declaration" if j > k else "class_declaration", k, brace, hi, name=self.word(j + 1))
        if self.lang != "JavaScript" and c[k] in ("interface", "enum", "type") and k + 2 < hi and c[k + 1] not in ("=", ".", "(", ";", ","):
            if c[k] == "type":
                n, nxt = self.simple("type_alias_declaration", k, hi)
                n.name = self.word(k + 1)
                return n, nxt
            brace = self.find(k, hi, "{")
            if brace < hi:
                return self.bodied(c[k] + "_declaration", k, brace, hi, name=self.word(k + 1))
        if c[k] in ("const", "let"):
            return self.simple("lexical_declaration", k, hi)
        if c[k] == "{":
            z = self.partner[k]
            return self.node("statement_block", k, min(z, hi - 1)), z + 1
        if c[k] in ("if", "for", "while", "try", "switch", "do"):
            z = k
            while True:  # to the end of the statement and of its branches
                z = self.find(z, hi, "{", ";")
                z = min(self.partner.get(z, z), hi - 1)
                if z + 1 < hi and c[z + 1] in ("else", "catch", "finally"):
                    z += 1
                    continue
                return self.node(c[k] + "_statement", k, z), z + 1
        return self.simple("variable_declaration" if c[k] == "var" else "expression_statement", k, hi)

    def _script_member(self, k, hi, parent):
        c = self.cls
        j = k
        while j < hi and c[j] not in ("(", "=", ";", "{"):
            if c[j] in ("[",):
                j = self.skip(j)
                continue
            if c[j] == ":" or c[j] == "<":
                break
            j += 1
        paren = self.find(k, hi, "(", "=", ";")
        if paren < hi and c[paren] == "(":
            brace = self.find(paren, hi, "{", ";")
            name = self.word(j - 1) if j > k else ""
            if brace < hi and c[brace] == "{":
                return self.bodied("method_definition", k, brace, hi, name=name)
            return self.node("method_signature", k, min(brace, hi - 1), name=name), brace + 1
        return self.simple("field_definition", k, hi)

    def _rust(self, k, hi, top, parent):
        c = self.cls
        if c[k] in (";", ","):
            return None, k + 1
        if c[k] == "#":
            j = k + 1 + (k + 1 < hi and c[k + 1] == "!")
            z = min(self.partner.get(j, j), hi - 1)
            return self.node("inner_attribute_item" if j > k + 1 else "attribute_item", k, z), z + 1
        j, vis = k, ""
        if c[j] == "pub":
            j += 1
            if j < hi and c[j] == "(":
                j = self.skip(j)
            vis = self.text[self.off[k] : self.end(j - 1)]
        if j >= hi:
            return self.simple("expression_statement", k, hi)
        if c[j] == "use":
            n, nxt = self.simple("use_declaration", k, hi)
            n.visibility = vis
            return n, nxt
        if c[j] == "extern" and j + 1 < hi and c[j + 1] == "crate":
            return self.simple("extern_crate_declaration", k, hi)
        m = j
        while m < hi and (c[m] in ("const", "async", "unsafe", "extern", "s") and m + 1 < hi and c[m + 1] in ("fn", "async", "unsafe", "extern", "s", "trait", "impl")):
            m += 1
        kinds = {"fn": "function_item", "struct": "struct_item", "enum": "enum_item", "union": "union_item", "trait": "trait_item", "mod": "mod_item", "type": "type_item", "impl": "impl_item", "const": "const_item", "static": "static_item"}
        kind = kinds.get(c[m] if m < hi else "")
        if kind in ("const_item", "static_item", "type_item"):
            n, nxt = self.simple(kind, k, hi)
            n.visibility, n.name = vis, self.word(m + 1) if m + 1 < hi else ""
            return n, nxt
        if kind:
            z = self.find(m, hi, "{", ";")
            name = self.word(m + 1) if kind != "impl_item" and m + 1 < hi else ""
            if z < hi and c[z] == "{":
                n, nxt = self.bodied(kind, k, z, hi, name=name, visibility=vis)
                if kind == "impl_item":
                    n.type = self._impl_type(m + 1, z)
                if kind in ("struct_item", "enum_item", "union_item", "function_item", "trait_item", "mod_item", "impl_item"):
                    return n, nxt
            n, nxt = self.simple(kind if kind != "function_item" else "function_signature_item", k, hi)
            n.name, n.visibility = name, vis
            return n, nxt
        z = self.find(k, hi, ";", "{")
        if z < hi and c[z] == "{":
            z = min(self.partner[z], hi - 1)
            return self.node("macro_invocation" if "!" in c[k:z] else "expression_statement", k, z), z + 1
        return self.simple("expression_statement", k, hi)

    def _impl_type(self, k, brace) -> str:
        """The text of the type that an impl is for."""
        if k < brace and self.cls[k] == "<":
            depth = 0
            while k < brace:
                depth += {"<": 1, ">": -1}.get(self.cls[k], 0)
                k += 1
                if not depth:
                    break
        start, depth = k, 0
        for x in range(k, brace):
            depth += {"<": 1, ">": -1}.get(self.cls[x], 0)
            if self.cls[x] == "for" and not depth:
                start = x + 1
        stop = next((x for x in range(start, brace) if self.cls[x] == "where"), brace)
        return self.text[self.off[start] : self.end(stop - 1)].strip() if start < stop else ""

    def _go(self, k, hi, top, parent):
        c = self.cls
        if c[k] == ";":
            return None, k + 1
        if c[k] == "func":
            method = k + 1 < hi and c[k + 1] == "("
            j = self.skip(k + 1) if method else k + 1
            name = self.word(j) if j < hi and c[j] == "i" else ""
            z = self.find(j, hi, "{", ";")
            while z < hi and c[z] == "{" and c[z - 1] in ("interface", "struct"):
                z = self.find(self.skip(z), hi, "{", ";")
            kind = "method_declaration" if method else "function_declaration"
            if z < hi and c[z] == "{":
                return self.bodied(kind, k, z, hi, name=name)
            n, nxt = self.simple(kind, k, hi)
            n.name = name
            return n, nxt
        kinds = {"package": "package_clause", "import": "import_declaration", "type": "type_declaration", "const": "const_declaration", "var": "var_declaration"}
        return self.simple(kinds.get(c[k], "expression_statement"), k, hi)

    def _java(self, k, hi, top, parent):
        c = self.cls
        if c[k] in (";", ","):
            return None, k + 1
        if c[k] in ("package", "import"):
            return self.simple("package_declaration" if c[k] == "package" else "import_declaration", k, hi)
        j = k
        while j < hi:
            if c[j] == "@" and j + 1 < hi and c[j + 1] != "interface":
                j += 2
                while j + 1 < hi and c[j] == ".":
                    j += 2
                if j < hi and c[j] == "(":
                    j = self.skip(j)
            elif c[j] in ("public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"):
                j += 1
            else:
                break
        mods = self.text[self.off[k] : self.end(j - 1)] if j > k else ""
        if j >= hi:
            return self.simple("expression_statement", k, hi)
        heads = {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration"}
        kind = heads.get(c[j]) if not (c[j] == "record" and (j + 1 >= hi or c[j + 1] != "i")) else None
        if c[j] == "@":
            kind, j = "annotation_type_declaration", j + 1
        if kind:
            brace = self.find(j, hi, "{")
            if brace < hi:
                return self.bodied(kind, k, brace, hi, name=self.word(j + 1) if j + 1 < hi else "", modifiers=mods)
        if c[j] == "{":
            z = min(self.partner[j], hi - 1)
            return self.node("block", k, z), z + 1
        stop = self.find(j, hi, "(", "=", ";")
        if stop < hi and c[stop] == "(" and c[stop - 1] in ("i", "record", "var", "yield", "sealed", "permits"):
            kind = "constructor_declaration" if stop == j + 1 else "method_declaration"
            z = self.find(stop, hi, "{", ";")
            name = self.word(stop - 1)
            if z < hi and c[z] == "{":
                return self.bodied(kind, k, z, hi, name=name, modifiers=mods)
            n, nxt = self.simple(kind, k, hi)
            n.name, n.modifiers = name, mods
            return n, nxt
        return self.simple("field_declaration", k, hi)

    def _c(self, k, hi, top, parent):
        c = self.cls
        if c[k] == ";":
            return None, k + 1
        if c[k] in ("public", "private", "protected") and k + 1 < hi and c[k + 1] == ":":
            return self.node("access_specifier", k, k + 1), k + 2
        if c[k] in ("namespace", "extern", "inline") and (c[k] == "namespace" or k + 1 < hi and c[k + 1] in ("s", "namespace")):
            z = self.find(k, hi, "{", ";")
            if z < hi and c[z] == "{":
                n, nxt = self.bodied("namespace_definition" if c[k] != "extern" else "linkage_specification", k, z, hi)
                return n, nxt
            return self.simple("declaration", k, hi)
        template = c[k] == "template"
        j = k
        while j < hi and c[j] in ("typedef", "static", "const"):
            j += 1
        if not template and j < hi and c[j] in ("struct", "class", "union", "enum"):
            z = self.find(j, hi, "{", ";", "(", "=")
            if z < hi and c[z] == "{":
                close = min(self.partner[z], hi - 1)
                plain = j == k and (close + 1 >= hi or c[close + 1] == ";")
                kind = {"struct": "struct_specifier", "class": "class_specifier", "union": "union_specifier", "enum": "enum_specifier"}[c[j]]
                if plain:
                    name = next((self.word(x) for x in range(j + 1, z) if c[x] == "i"), "")
                    n, nxt = self.bodied(kind, k, z, hi, name=name)
                    return n, nxt + (nxt < hi and c[nxt] == ";")
                return self.simple("type_definition" if c[k] == "typedef" else "declaration", k, hi)
        z = self.find(k, hi, "{", ";", "=")
        if z < hi and c[z] == "=" and k < z and c[z - 1] == "operator":
            z = self.find(z + 1, hi, "{", ";")
        if z < hi and c[z] == "{" and ")" in c[k:z]:
            return self.bodied("template_declaration" if template else "function_definition", k, z, hi)
        return self.simple("template_declaration" if template else "field_declaration" if parent is not None else "declaration", k, hi)
