"""Tokens of the nine parsed languages.

``tokens(text, lang)`` gives classes and offsets; a token no language has ("!" and a
name) never fits a grammar.
"""

from __future__ import annotations

import re

from . import words as G

MARKER = r"(?P<mark>(?m:^)(?:<{7}(?:[ \t][^\n]*)?|\|{7}(?:[ \t][^\n]*)?|={7}[ \t\r]*|>{7}(?:[ \t][^\n]*)?)(?=\r?(?:\n|\Z)))"
SPACE = r"(?P<ws>[ \t\f\v\r\u00a0\ufeff]+)|(?P<nl>\n)"
SLASH = r"(?P<com>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<bad>/\*)"
WORD = r"(?P<w>[^\W\d]\w*)"
CLOSERS = {")": "(", "]": "[", "}": "{"}
PARTNER = {"(": ")", "[": "]", "{": "}"}


def _marks(text: str) -> str:
    return "(?P<op>" + "|".join(re.escape(x) for x in sorted(text.split(), key=len, reverse=True)) + ")"


_PY_NUM = r"(?P<n>0[xX](?:_?[0-9a-fA-F])+(?!\w)|0[oO](?:_?[0-7])+(?!\w)|0[bB](?:_?[01])+(?!\w)|(?:(?:[1-9](?:_?\d)*|0(?:_?0)*)(?![\d_.eEjJ])(?!\w)|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?(?!\w)|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?(?!\w)|\d(?:_?\d)*[jJ](?!\w)))|(?P<num>\.?\d\w*)"
_C_NUM = r"(?P<n>0[xX][\da-fA-F'_]+(?:\.[\da-fA-F]*)?(?:[pP][+-]?\d+)?[uUlLfFzZ]*(?!\w)|0[bB][01'_]+[uUlLzZ]*(?!\w)|(?:\d[\d'_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[uUlLfFdDzZ]*(?!\w))|(?P<num>\.?\d\w*)"
_JS_NUM = r"(?P<n>0[xX][\da-fA-F_]+n?(?!\w)|0[bB][01_]+n?(?!\w)|0[oO][0-7_]+n?(?!\w)|(?:(?:0|[1-9][\d_]*)(?!\d)\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?(?!\w))|(?P<num>\.?\d\w*)"
_GO_NUM = r"(?P<n>0[xX][\da-fA-F_]+(?!\w)|0[bB][01_]+(?!\w)|0[oO]?[0-7_]+(?![\w.])|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?(?!\w))|(?P<num>\.?\d\w*)"
_RS_NUM = r"(?P<n>0x[\da-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?(?!\w)|0b[01_]+(?:[iu](?:8|16|32|64|128|size))?(?!\w)|0o[0-7_]+(?:[iu](?:8|16|32|64|128|size))?(?!\w)|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w))|(?P<num>\d\w*)"
_DQ = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*'"

_PY_PRE = r"(?:[rR]?[bB]|[bB]?[rR]|[uU]|[fF]?[rR]|[rR]?[fF]|[tT])?"
SPEC = {
    "Python": (
        MARKER + r"|(?P<ws>[ \t\f\ufeff]+|\\\r?\n)|(?P<nl>\r?\n|\r)|(?P<com>\#[^\n]*)|(?P<s>" + _PY_PRE + r'(?:"""(?:[^\\]|\\[\s\S])*?"""|' + r"'''(?:[^\\]|\\[\s\S])*?'''|" + _DQ + "|" + _SQ + r"))|(?P<bad>" + _PY_PRE + r"['\"])|" + _PY_NUM + "|" + WORD + "|"
        + _marks("+ - * ** / // % @ << >> & | ^ ~ := < > <= >= == != -> += -= *= /= //= %= @= &= |= ^= >>= <<= **= . ... , : ; = ( ) [ ] { }"),
        G.PYTHON_WORDS,
    ),
    "Rust": (
        MARKER + "|" + SPACE + r"|(?P<com>//[^\n]*)|(?P<nest>/\*)|(?P<s>(?:b|c)?r(?P<h>\#*)\"[\s\S]*?\"(?P=h)|[bc]?\"(?:[^\"\\]|\\[\s\S])*\")|(?P<c>b?'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u\{[\da-fA-F_]+\}|[^\n]))')|(?P<l>'[^\W\d]\w*)|(?P<bad>[\"'])|" + _RS_NUM + r"|r\#(?P<raw>[^\W\d]\w*)|" + WORD + "|"
        + _marks("+ - * / % ^ ! & | && || << += -= *= /= %= ^= &= |= <<= = == != > < <= @ . .. ... ..= , ; : :: -> => # $ ? ~ ( ) [ ] { }"),
        G.RUST_WORDS,
    ),
    "Go": (
        MARKER + "|" + SPACE + "|" + SLASH + r"|(?P<s>" + _DQ.replace(r"\\[\s\S]", r"\\[^\n]") + r"|`[^`]*`)|(?P<c>'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|[abfnrtv\\'\"]))')|(?P<bad2>[\"'`])|" + _GO_NUM + "|" + WORD + "|"
        + _marks("+ - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- == < > = ! != <= >= := ... , . ; : ~ ( ) [ ] { }"),
        G.GO_WORDS,
    ),
    "Java": (
        MARKER + "|" + SPACE + "|" + SLASH + r'|(?P<s>"""(?:[^\\]|\\[\s\S])*?"""|' + _DQ.replace(r"\\[\s\S]", r"\\[^\n]") + r")|(?P<c>'(?:[^'\\\n]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|[btnfrs\\'\"]))')|(?P<bad2>[\"'])|" + _C_NUM + "|" + WORD.replace("[^\\W\\d]\\w*", "(?:[^\\W\\d]|\\$)[\\w$]*") + "|"
        + _marks("+ - * / % ++ -- == != < > <= && || ! ~ & | ^ << = += -= *= /= %= &= |= ^= <<= ? : :: ; , . ... -> @ ( ) [ ] { }"),
        G.JAVA_WORDS,
    ),
}
_C_BODY = MARKER + "|" + SPACE + r"|(?P<com>//(?:[^\n\\]|\\\r?\n|\\)*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<bad>/\*)|(?P<pre>(?m:^)[ \t]*\#(?:[^\n\\/]|\\\r?\n|\\|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*)"
_C_STR = r"|(?P<c>(?:u8|[uUL])?'(?:[^'\\\n]|\\[^\n])+')|(?P<bad2>[\"'])|"
_C_MARKS = "+ - * / % ++ -- == != < > <= && || ! ~ & | ^ << = += -= *= /= %= &= |= ^= <<= ? : ; , . ... -> ( ) [ ] { }"
_CS = _DQ.replace(r"\\[\s\S]", r"\\(?:\r?\n|[^\n])")
SPEC["C"] = (_C_BODY + r"|(?P<s>(?:u8|[uUL])?" + _CS + ")" + _C_STR + _C_NUM + "|" + WORD + "|" + _marks(_C_MARKS), G.C_WORDS)
SPEC["Cpp"] = (_C_BODY + r'|(?P<s>(?:u8|[uUL])?R"(?P<h>[^()\\\s]{0,16})\([\s\S]*?\)(?P=h)"|(?:u8|[uUL])?' + _CS + ")" + _C_STR + _C_NUM + "|" + WORD + "|" + _marks(_C_MARKS + " ::"), G.CPP_WORDS)
_JS = (
    MARKER + "|" + SPACE + "|" + SLASH + r"|(?P<s>" + _DQ.replace(r"\\[\s\S]", r"\\(?:\r?\n|[^\n])") + "|" + _SQ.replace(r"\\[\s\S]", r"\\(?:\r?\n|[^\n])") + r")|(?P<t>`)|(?P<bad2>[\"'])|" + _JS_NUM + r"|(?P<w>(?:[^\W\d]|\$)[\w$]*)|(?P<slash>/=?)|(?P<lt><(?![<=]))|"
)
_JS_MARKS = "+ - * /= % ** ++ -- << = == === != !== < <= && || ?? ! ~ & | ^ += -= *= %= **= <<= &= |= ^= &&= ||= ??= ? ?. : ; , . ... => @ # ( ) [ ] { }"
SPEC["JavaScript"] = (_JS + _marks(_JS_MARKS + " > >= >> >>> >>= >>>="), G.JS_WORDS)
SPEC["TypeScript"] = (_JS + r"(?P<gt>>)|" + _marks(_JS_MARKS), G.TS_WORDS)
SPEC["Tsx"] = SPEC["TypeScript"]

SCAN = {k: (re.compile(a), frozenset(b)) for k, (a, b) in SPEC.items()}
DIRECTIVES = frozenset("include include_next define undef if ifdef ifndef elif elifdef elifndef else endif line error warning pragma import ident embed".split())
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_VALUE_END = frozenset(["i", "n", "s", "r", "t", "/jsx", ")", "]", "}", "this", "super", "null", "true", "false"])
_ASI_END = _VALUE_END | frozenset(["return", "break", "continue", "++", "--", "debugger"])
_NO_ASI_WORD = frozenset(["in", "instanceof", "else", "catch", "finally", "extends", "implements", "of", "as", "is", "satisfies", "from"])
# Words that no expression holds: at the start of a line they end an open bracket's claim to the line.
_PY_STATEMENT = frozenset(["def", "class", "return", "import", "while", "with", "try", "except", "finally", "raise", "assert", "del", "pass", "break", "continue", "global", "nonlocal"])
_GO_END = frozenset(["i", "n", "s", "c", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


def tokens(text: str, lang: str, aside: list | None = None):
    """(classes, offsets); aside, if given, gets (kind, start, end) of comments and preprocessor lines."""
    if lang == "Python":
        return _python(text, aside)
    if lang in ("JavaScript", "TypeScript", "Tsx"):
        return _Script(text, lang, aside).run()
    return _plain(text, lang, aside)


_TEMPLATE = re.compile(r"`(?:[^`\\]|\\[\s\S])*`")


def token_end(text: str, lang: str, cls: str, off: int) -> int:
    """Where a token ends."""
    if cls in ("/jsx", "nl", "{B", "}B") or cls == "t" and text[off - 1 : off] == "`":
        return off
    if text.startswith("`", off):
        m = _TEMPLATE.match(text, off)
        return m.end() if m else len(text)
    if cls == "r":
        return _REGEX.match(text, off).end()
    if cls == ";" and not text.startswith(";", off):
        return off
    m = SCAN[lang][0].match(text, off)
    return m.end() if m else off + 1


def _plain(text: str, lang: str, aside: list | None = None):
    pattern, words = SCAN[lang]
    match = pattern.match
    cls: list = []
    off: list = []
    pos, n = 0, len(text)
    go, c_like = lang == "Go", lang in ("C", "Cpp")
    conds: list = []
    skip = 0
    while pos < n:
        m = match(text, pos)
        if m is None:
            cls.append("!char")
            off.append(pos)
            pos += 1
            continue
        kind, start, pos = m.lastgroup, pos, m.end()
        if kind == "ws" or kind == "com":
            if kind == "com" and aside is not None:
                aside.append(("comment", start, pos))
            if go and kind == "com" and text[start + 1] == "*" and "\n" in m.group() and cls and cls[-1] in _GO_END:
                cls.append(";")
                off.append(start)
            continue
        if kind == "nl":
            if go and cls and cls[-1] in _GO_END:
                cls.append(";")
                off.append(start)
            continue
        if kind == "pre":
            word = re.match(r"[ \t]*#\s*([A-Za-z_]\w*)?", m.group())[1]
            if aside is not None:
                aside.append(("include" if word == "include" else "directive", start + len(m.group()) - len(m.group().lstrip()), start + len(m.group().rstrip())))
            if word is None and not m.group().strip(" \t#\r"):
                continue
            if word not in DIRECTIVES:
                if not skip:
                    cls.append("!directive")
                    off.append(start)
            elif word in ("if", "ifdef", "ifndef"):
                conds.append(start)
                if skip or re.match(r"[ \t]*#\s*if\s+0\s*$", m.group()):
                    skip += 1
            elif word == "endif":
                if conds:
                    conds.pop()
                else:
                    cls.append("!directive")
                    off.append(start)
                skip = max(0, skip - 1)
            elif skip == 1 and word in ("else", "elif"):
                skip = 0
            continue
        if skip:
            continue
        if kind == "w":
            w = m.group()
            cls.append(w if w in words else "i")
        elif kind == "op":
            cls.append(m.group())
        elif kind in ("n", "s", "c", "l"):
            cls.append(kind)
        elif kind == "h":
            cls.append("s")
        elif kind == "raw":
            cls.append("i")
        elif kind == "mark":
            cls.append("!mark")
        elif kind == "nest":
            depth, at = 1, pos
            while depth:
                x = re.compile(r"/\*|\*/").search(text, at)
                if not x:
                    break
                depth += 1 if x.group() == "/*" else -1
                at = x.end()
            if depth:
                cls.append("!open")
                off.append(start)
                break
            pos = at
            if aside is not None:
                aside.append(("comment", start, pos))
            continue
        else:
            cls.append("!open" if kind.startswith("bad") else "!number")
            if kind.startswith("bad"):
                off.append(start)
                end = text.find("\n", pos) if text[start] != "/" and text[start] != "`" and lang != "Rust" else n
                pos = n if end < 0 else end
                continue
        off.append(start)
    if conds:
        cls.append("!directive")
        off.append(n)
    if go and cls and cls[-1] in _GO_END:
        cls.append(";")
        off.append(n)
    return cls, off


def _python(text: str, aside: list | None = None):
    pattern, words = SCAN["Python"]
    match = pattern.match
    cls: list = []
    off: list = []
    pos, n, depth = 0, len(text), 0
    levels = [0]
    fresh, indent, begun = True, 0, True  # begun: nothing but white space since the line began, inside brackets too
    while pos < n:
        m = match(text, pos)
        if m is None:
            kind, start, pos, w = "bad1", pos, pos + 1, text[pos]
        else:
            kind, start, pos, w = m.lastgroup, pos, m.end(), m.group()
        if kind == "ws":
            if begun and w[0] != "\\":
                indent = len(w.lstrip("\ufeff").expandtabs(8))
            continue
        if kind == "com":
            if aside is not None:
                aside.append(("comment", start, pos))
            continue
        if kind == "nl":
            if not depth:
                if not fresh:
                    cls.append("nl")
                    off.append(start)
                fresh = True
            begun, indent = True, 0
            continue
        if begun and depth and w in _PY_STATEMENT:
            cls.append("nl")
            off.append(start)
            depth, fresh = 0, True
        begun = False
        if fresh and not depth:
            fresh = False
            if kind != "mark":
                if indent > levels[-1]:
                    levels.append(indent)
                    cls.append("{B")
                    off.append(start)
                else:
                    while indent < levels[-1]:
                        levels.pop()
                        cls.append("}B")
                        off.append(start)
                    if indent != levels[-1]:
                        cls.append("!dedent")
                        off.append(start)
        if kind == "w":
            cls.append(w if w in words else "i")
        elif kind == "op":
            if w in "([{":
                depth += 1
            elif w in ")]}":
                depth = max(0, depth - 1)
            cls.append(w)
        elif kind in ("n", "s"):
            cls.append(kind)
        elif kind == "mark":
            cls.append("!mark")
            fresh = begun = True
        else:
            cls.append("!open" if kind.startswith("bad") else "!number")
            if kind == "bad":
                off.append(start)
                triple = w[-1] * 2
                end = -1 if text.startswith(triple, pos) else text.find("\n", pos)
                pos = n if end < 0 else end
                continue
        off.append(start)
    if not fresh:
        cls.append("nl")
        off.append(n)
    for _ in levels[1:]:
        cls.append("}B")
        off.append(n)
    return cls, off


class _Script:
    """JavaScript and TypeScript: regular expressions, templates, JSX and semicolons left out."""

    def __init__(self, text: str, lang: str, aside: list | None = None):
        self.aside = aside
        self.text, self.n = text, len(text)
        self.pattern, self.words = SCAN[lang]
        self.jsx = lang != "TypeScript"
        self.tsx = lang == "Tsx"
        self.cls: list = []
        self.off: list = []

    def add(self, c, o):
        self.cls.append(c)
        self.off.append(o)

    def run(self):
        self.code(max(0, self.text.find("\n")) if self.text.startswith("#!") else 0, None)
        return self.cls, self.off

    def code(self, pos: int, stop: str | None) -> int:
        """Lexes from pos; with stop, up to the "}" that closes what was opened before pos."""
        text, n, match, words, cls, add = self.text, self.n, self.pattern.match, self.words, self.cls, self.add
        stack: list = []
        newline = False
        while pos < n:
            m = match(text, pos)
            if m is None:
                add("!char", pos)
                pos += 1
                continue
            kind, start, pos = m.lastgroup, pos, m.end()
            if kind == "ws":
                continue
            if kind == "nl":
                newline = True
                continue
            if kind == "com":
                if self.aside is not None:
                    self.aside.append(("comment", start, pos))
                newline = newline or "\n" in m.group()
                continue
            w = m.group()
            prev = cls[-1] if cls else ";"
            if newline:
                newline = False
                if (not stack or stack[-1] == "{") and (prev in _ASI_END or prev.isalpha() and prev in ("static", "get", "set", "async", "of", "from", "let", "type")) and (kind in ("w", "s", "n", "t", "mark") and w not in _NO_ASI_WORD or w in ("@", "++", "--", "#", "{") and prev not in (")", "}")  or w in ("@", "#") or w == "[" and prev == ";"):
                    if not (w == "{" and prev in ("i", ")", "]", ">")):
                        add(";", start)
                        prev = ";"
            if kind == "w":
                add("i" if prev in (".", "?.") else w if w in words else "i", start)
                continue
            if kind == "slash":
                if self.value(prev):
                    add(w, start)
                    continue
                r = _REGEX.match(text, start)
                if r:
                    add("r", start)
                    pos = r.end()
                else:
                    add("!open", start)
                continue
            if kind == "lt":
                if self.jsx and not self.value(prev) and pos < n and (_JSX_NAME.match(text, pos) or text[pos] == ">") and not (self.tsx and re.match(r"[A-Za-z_$][\w$]*\s*(?:,|extends\b)", text[pos:pos + 60])):
                    add("jsx", start)
                    pos = self.element(start)
                    add("/jsx", pos)
                else:
                    add("<", start)
                continue
            if kind == "gt":
                add(">", start)
                nxt = text[pos : pos + 1]
                if nxt == "=" and not self.angle():
                    self.cls[-1] = ">="
                    pos += 1
                elif nxt == ">" and not self.angle():
                    k = re.compile(r">{0,2}=?").match(text, pos).end()
                    self.cls[-1] = text[start:k]
                    pos = k
                continue
            if kind == "t":
                pos = self.template(start)
                continue
            if kind == "op":
                if w in "([{":
                    stack.append(w)
                elif w in ")]}":
                    if w == "}" and stop and not stack:
                        add("}", start)
                        return pos
                    if stack:
                        stack.pop()
                add(w, start)
                continue
            if kind in ("n", "s"):
                add(kind, start)
            elif kind == "mark":
                add("!mark", start)
            elif kind == "num":
                add("!number", start)
            else:
                add("!open", start)
                end = text.find("\n", pos) if w != "/*" else n
                pos = n if end < 0 else end
        return pos

    def angle(self) -> bool:
        """Is a type-argument bracket open on this line's tokens?"""
        depth = 0
        for c in reversed(self.cls[-40:-1]):
            if c in (";", "{", "}", "&&", "||", "if", "while", "return"):
                break
            if c == "<":
                depth += 1
            elif c == ">":
                depth -= 1
        return depth > 0

    @staticmethod
    def value(prev: str) -> bool:
        return prev in _VALUE_END or prev in ("of", "get", "set", "from", "as", "type", "static", "async", "namespace", "declare", "module", "abstract", "++", "--")

    def template(self, start: int) -> int:
        text, pos, holes = self.text, start + 1, 0
        first = len(self.cls)
        self.add("t", start)
        find = re.compile(r"\\[\s\S]|`|\$\{").search
        while True:
            m = find(text, pos)
            if not m:
                self.add("!open", start)
                return self.n
            pos = m.end()
            if m.group() == "`":
                break
            if m.group() == "${":
                holes += 1
                self.add("{", m.start())
                pos = self.code(pos, "}")
        if holes:
            self.add("t", pos)
        else:
            self.cls[first] = "s"
        return pos

    def element(self, start: int) -> int:
        """A JSX element from its "<"; gives the place after it."""
        text, n, pos = self.text, self.n, start + 1
        m = _JSX_NAME.match(text, pos)
        name = m.group() if m else ""
        pos += len(name)
        while True:  # attributes
            while pos < n and text[pos].isspace():
                pos += 1
            if pos >= n:
                self.add("!open", start)
                return n
            if text.startswith("/>", pos):
                return pos + 2
            if text[pos] == ">":
                pos += 1
                break
            if text[pos] == "{":
                self.add("{", pos)
                pos = self.code(pos + 1, "}")
                continue
            m = _JSX_NAME.match(text, pos)
            if not m:
                self.add("!char", pos)
                return pos + 1
            pos = m.end()
            m = re.compile(r"\s*=\s*(\"[^\"]*\"|'[^']*'|\{)").match(text, pos)
            if m:
                pos = m.end()
                if m.group(1) == "{":
                    self.add("{", pos - 1)
                    pos = self.code(pos, "}")
        find = re.compile(r"[<{]").search
        while True:  # children
            m = find(text, pos)
            if not m:
                self.add("!open", start)
                return n
            pos = m.end()
            if m.group() == "{":
                self.add("{", m.start())
                pos = self.code(pos, "}")
            elif text.startswith("/", pos):
                m = re.compile(r"/\s*([\w$.:-]*)\s*>").match(text, pos)
                if not m or m.group(1) != name:
                    self.add("!close", pos)
                return m.end() if m else pos + 1
            else:
                pos = self.element(pos - 1)
