"""Problem 4: functions paired with their documentation.

The comments of a file are candidates for its functions.  A link's weight comes from
parameter tags, names and distance; per connected part of the candidate graph a
bipartite assignment of least cost picks the links.  Implausible links and descriptions
that say no more than the name, the parameters and bare tags are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_MARKS = re.compile(r"(?m)^[ \t]*(?:/\*+!?|\*+/|\*(?!\*)|///?!?|//!|#+!?|--+|;+|\"\"\"|'''|[rRuU]?\"\"\"|<!--)[ \t]?|[ \t]*(?:\*+/|\"\"\"|'''|-->)[ \t]*$")
_TAG = re.compile(r"(?i)^[@\\:](param|parameter|arg|argument|tparam|return|returns|rtype|throws|raises|exception|type|see|since|deprecated|internal|inheritdoc|override|author|version|private|public|protected|static|async|todo|ignore|hidden|module|function|method|class|name)\b:?\s*(.*)$")
_PARAM_TAG = re.compile(r"(?im)[@\\:](?:param|arg|argument|parameter)\s+(?:\{[^}]*\}\s*)?([A-Za-z_]\w*)")
# Lines that are about the file, its tools or its state, not about what the symbol does.
_NOISE = re.compile(
    r"(?i)^\W*(?:todo|fixme|xxx|hack|tbd|tba|wip|nolint|noqa|noinspection|pylint|flake8|mypy|pyright|type:\s*ignore|eslint|tslint|jshint|jslint|prettier|istanbul|c8|v8|coverage|pragma|clang-format|clang-tidy|rustfmt|clippy|checkstyle|spotbugs|suppress\w*|"
    r"region|endregion|section|copyright|\(c\)|licen[cs]e|spdx|all rights reserved|author|authors|created (?:on|by|at)|modified (?:on|by)|last modified|date|version|revision|history|changelog|"
    r"(?:auto[- ]?)?generated|autogenerated|this (?:method|function|class|code|file) (?:was|is) (?:auto)?\s*generated|do not (?:edit|modify|touch)|lorem ipsum|description(?: goes here)?|documentation|insert (?:description|documentation|doc)|add (?:description|documentation|doc)|write (?:docs?|documentation)|"
    r"\(?(?:no|missing|without) (?:comments?|docs?|documentation|description)\b.*|undocumented|not documented|to be (?:documented|done|written|determined)|placeholder|dummy|stub|none|null|n/?a|see above|see below|see source|same as above|ditto|as above|self[- ]explanatory|"
    r"siehe (?:oben|unten)|wie oben|voir (?:plus haut|ci-dessus)|ver arriba|см\. выше|同上|inherit(?:ed)?\s?doc|\{@inheritdoc\}|deprecated|internal|private|public|override[sn]?|implements?|unused|helper|helpers|util|utils|misc|getter|setter|constructor|destructor|default constructor)\b"
)
_CODE = re.compile(r"^\W*(?:[\w.]+\s*(?:[+\-*/|&]?=|:=)\s*[\w.]+\s*\(.*\)\s*;?|(?:return|if|for|while|var|let|const|import|from|print|self\.|this\.)\b.*[;(){}:]\s*|[\w.]+\([^)]*\)\s*;?|[\w.]+(?:\[[^\]]*\])?\s*[+\-*/]?=\s*[^ ]+;?)$")
# Words that carry no description by themselves.
_EMPTY_WORDS = frozenset(
    """a an the this that these those it its is are was were be been being do does did done of to in on at by for from with and or but not no as if then than so such into onto out over under up
    function functions method methods procedure routine subroutine operation class object instance member symbol code implementation impl value values parameter parameters param params argument arguments arg args
    return returns returned returning result results given specified some any all each one here there used use uses using handle handles perform performs performing execute executes run runs call calls called
    der die das ein eine und oder ist von für mit el la los las un una y o es de le les des et est""".split()
)
_WORD = re.compile(r"[^\W\d_]+(?:'[a-z]+)?")
_WIDE = re.compile("[぀-ヿ㐀-䶿一-鿿가-힯]")


_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
_RECEIVER = re.compile(r"\s*func\s*\(")
_NESTED = re.compile(r"[(\[{<>}\])]")
_SCOPE = re.compile(r"(?:\w+)?::")
_IDENT = re.compile(r"[A-Za-z_]\w*")
# Words in a parameter list that are no parameter.
_NO_PARAM = frozenset(("self", "this", "cls", "const", "mut", "final"))


@lru_cache(1 << 15)
def parts(name: str | None) -> tuple[str, ...]:
    return tuple(w.lower() for w in _PARTS.findall(name or ""))


def parameters(signature: str | None) -> list[str]:
    """Names in the outermost parentheses of a signature; a signature cut short still gives what it has."""
    return list(_parameters(signature or ""))


@lru_cache(1 << 12)
def _parameters(s: str) -> tuple[str, ...]:
    if _RECEIVER.match(s):  # a receiver comes first
        s = s.split(")", 1)[-1]
    at = s.find("(")
    if at < 0:
        return ()
    end = s.find(")", at)
    inner = s[at + 1 : end if end >= 0 else len(s)]
    if not _NESTED.search(inner):
        items = inner.split(",")
    else:
        depth, item, items = 0, "", []
        for ch in s[at + 1 :]:
            if ch in "([{<":
                depth += 1
            elif ch in ")]}>":
                if depth == 0:
                    break
                depth -= 1
            if ch == "," and depth == 0:
                items.append(item)
                item = ""
            else:
                item += ch
        items.append(item)
    out = []
    for it in items:
        it = it.split("=")[0]
        if "::" in it:
            it = _SCOPE.sub("", it)  # std::string name, not a name and its type
        words = _IDENT.findall(it.split(":")[0] if ":" in it else it)
        if words:
            out += [words[0], words[-1]] if len(words) > 1 else words
    return tuple(w for w in dict.fromkeys(out) if w not in _NO_PARAM)


@lru_cache(1 << 16)
def stem(w: str) -> str:
    w = w.lower()
    for end in ("ies", "ied"):
        if w.endswith(end) and len(w) > 4:
            return w[:-3] + "y"
    for end in ("ing", "ed", "es", "s", "er", "or"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "aeiou":
        w = w[:-1]
    return w[:-1] if w.endswith("e") and len(w) > 3 else w


def description(doc: str | None) -> list[str]:
    """What remains of a comment without marks, bare tags, tool lines, rules and commented-out code."""
    text = _MARKS.sub("", doc or "")
    lines, out = [x.strip() for x in text.replace("\r", "").split("\n")], []
    for x in lines:
        x = x.strip("*/#\"' \t-=_~.!?<>") if not re.search(r"\w", x) else x
        if not re.search(r"\w", x):
            continue
        tag = _TAG.match(x)
        if tag:
            kind, rest = tag[1].lower(), tag[2]
            if kind in ("param", "parameter", "arg", "argument", "tparam"):
                m = re.match(r"(?:\{[^}]*\}\s*)?([A-Za-z_]\w*)?\s*[-:]?\s*(.*)", rest)
                out.append(m[2])
            elif kind in ("return", "returns", "throws", "raises", "exception", "deprecated"):
                out.append(rest)
            continue
        if _NOISE.match(x) or _CODE.match(x):
            continue
        out.append(x)
    return [x for x in out if x]


_LEAD = re.compile(r"\W*([^\W\d]\w*)(\(\))?")
_ONE_WORD = re.compile(r"\w+")


def says(name: str | None, signature: str | None, doc: str | None, least: int = 2) -> int:
    """How many words of the description neither the name nor the parameters nor empty words hold; 0 below least."""
    known = {stem(w) for w in parts(name)} | {stem(w) for p in parameters(signature) for w in parts(p)}
    new = 0
    for line in description(doc):
        if not line.isascii():
            new += len(_WIDE.findall(line)) // 2
            line = _WIDE.sub(" ", line)
        for w in _WORD.findall(line):
            if len(w) > 1 and w.lower() not in _EMPTY_WORDS and stem(w) not in known:
                new += 1
    return new if new >= least else 0


def leads(doc: str, name: str | None) -> bool:
    """Whether a comment begins with a name that no word of a sentence is: one of several parts, or with its parentheses."""
    if not name or name not in doc:
        return False
    m = _LEAD.match(_MARKS.sub("", doc))
    return bool(m and m[1] == name and (m[2] or len(parts(name)) > 1))


def cost(doc: str, own: int, fn: tuple, k: int) -> float:
    """Of linking a comment that stands before function number own with function number k of the file."""
    name, params = fn
    tags = {t.lower() for t in _PARAM_TAG.findall(doc)}
    have = {p.lower() for p in params}
    c = abs(k - own) * 1.25
    if tags:
        c += 3.0 * len(tags - have) / len(tags)
    words = {stem(w) for w in _WORD.findall(doc)}
    named = [stem(w) for w in parts(name)]
    if named and leads(doc, name):
        c -= 3.0
    elif named and name and name in doc and name in _ONE_WORD.findall(doc):
        c -= 1.0
    elif named:
        c -= 0.5 * sum(w in words for w in named) / len(named)
    return c


#: Links dearer than this are implausible, as one of a comment all of whose tags are foreign (3.0) or most and no word of the name;
#: a comment may go to a neighbour this far away (2.5 where its tags fit).
IMPLAUSIBLE, REACH = 2.6, 2


def links(functions: list[tuple], comments: list[str]) -> dict[int, dict[int, float]]:
    """{comment: {function: cost}}: the links that can be in a cheapest assignment.

    functions are (name, params) in file order, comments[i] is the one before function i ("" for
    none).  A comment competes for neighbours where its tags do not fit its own function but theirs,
    where it names them and not its own function and its tags, if any, fit them, or where another comment
    wants its function; anywhere else its own function is the cheapest.
    """
    n = len(functions)
    edges: dict[int, dict[int, float]] = {}
    have = [frozenset(p.lower() for p in params) for _, params in functions]
    for i, doc in enumerate(comments):
        if not doc:
            continue
        tags = {t.lower() for t in _PARAM_TAG.findall(doc)} if "@" in doc or ":" in doc or "\\" in doc else set()
        foreign = bool(tags) and not tags <= have[i]
        near = [k for k in range(max(0, i - REACH), min(n, i + REACH + 1)) if k != i]
        named = [k for k in near if functions[k][0] and functions[k][0] in doc]
        if named:
            words = set(_ONE_WORD.findall(doc))
            named = [k for k in named if functions[k][0] in words] if functions[i][0] not in words else []
        rivals = [k for k in (near if foreign else named) if tags <= have[k]]
        if not foreign and not rivals:  # the link to its own function is the cheapest, and plausible
            edges[i] = {i: 0.0}
            continue
        edges[i] = {k: cost(doc, i, functions[k], k) for k in [i, *rivals]}
    restless = [i for i, e in edges.items() if len(e) > 1]
    for i in restless:  # a comment whose function another one wants may go where that one came from, or where there is none
        for j in [k for k in edges[i] if k != i and k in edges and len(edges[k]) == 1]:
            doc = comments[j]
            tags = {t.lower() for t in _PARAM_TAG.findall(doc)}
            free = [k for k in range(max(0, j - REACH), min(n, j + REACH + 1)) if k != j and (k == i or k not in edges) and tags <= have[k]]
            edges[j] = {k: cost(doc, j, functions[k], k) for k in [j, *free]}
    return edges


def assign(functions: list[tuple], comments: list[str]) -> list[int | None]:
    """For each function the index of the comment assigned to it: least total cost over ``links``, none if implausible.

    As many comments as can be are assigned.  The links fall into parts of a few nodes; each is
    solved by shortest augmenting paths.
    """
    edges = links(functions, comments)
    owner: dict[int, int] = {}
    for i in edges:  # successive augmenting: Bellman-Ford over the few alternating paths
        dist, back, todo = {k: c for k, c in edges[i].items()}, {k: (i, None) for k in edges[i]}, list(edges[i])
        while todo:
            k = todo.pop()
            j = owner.get(k)
            if j is None:
                continue
            for k2, c in edges[j].items():
                d = dist[k] - edges[j][k] + c
                if k2 != k and d < dist.get(k2, 1e9) - 1e-9:
                    dist[k2], back[k2] = d, (j, k)
                    todo.append(k2)
        free = [k for k in dist if k not in owner]
        if free:
            k = min(free, key=lambda k: (dist[k], k))
            while k is not None:
                j, before = back[k]
                owner[k], k = j, before
    return [owner[k] if k in owner and edges[owner[k]][k] <= IMPLAUSIBLE else None for k in range(len(functions))]


_SCHEMA = "symbol_id bigint, file_id bigint, name string, kind string, signature string, doc_comment string, words int"
#: Lines of a file that are judged together; comments stand beside their functions, so a cut loses nothing but links across it.
BLOCK_LINES = 20_000


def pairs(symbols: DataFrame) -> DataFrame:
    """Each function or method (in any case) with a non-blank signature and the comment assigned to it.

    words is how many words the comment adds, 0 where it is trivial or missing.  Rows of one
    symbol_id count once, the latest wins; null file_id, lines or names are allowed, a null
    symbol_id is not.  A file with very many symbols is cut into blocks of lines.
    """

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group = None, []

        def flush():
            if not group:
                return None
            fns = [(r[2], parameters(r[4])) for r in group]
            took = assign(fns, [r[5] or "" for r in group])
            rows = []
            for k, r in enumerate(group):
                doc = group[took[k]][5] if took[k] is not None else None
                rows.append((r[0], r[1], r[2], r[3], r[4], doc, says(r[2], r[4], doc) if doc else 0))
            return pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")])

        ready = []
        for pdf in batches:
            for r in pdf.itertuples(index=False, name=None):
                this = (r[1], r[6])
                if this != key or pd.isna(r[1]):
                    if (out := flush()) is not None:
                        ready.append(out)
                    key, group = this, []
                group.append(r[:6])
                if len(ready) > 2000:
                    yield pd.concat(ready)
                    ready = []
        if (out := flush()) is not None:
            ready.append(out)
        if ready:
            yield pd.concat(ready).astype({"file_id": "Int64"})

    s = symbols.where("symbol_id is not null").select("symbol_id", F.struct("indexed_at", "file_id", "name", "kind", "signature", "doc_comment", "line_start").alias("r"))
    s = s.groupBy("symbol_id").agg(F.max("r").alias("r")).select("symbol_id", "r.*")
    s = s.where(F.lower(F.trim("kind")).isin("function", "method") & F.col("signature").rlike(r"\S"))
    s = s.withColumn("block", F.floor(F.coalesce("line_start", F.lit(0)) / BLOCK_LINES).cast("int")).withColumn("kind", F.lower(F.trim("kind")))
    s = s.repartition(common.tasks(symbols.sparkSession), "file_id", "block").sortWithinPartitions("file_id", "block", "line_start", "symbol_id")
    return s.select("symbol_id", "file_id", "name", "kind", "signature", "doc_comment", "block").mapInPandas(link, _SCHEMA)


def documented(symbols: DataFrame) -> DataFrame:
    """symbol_id of functions and methods whose comment says something."""
    return pairs(symbols).where("words > 0").select("symbol_id")
