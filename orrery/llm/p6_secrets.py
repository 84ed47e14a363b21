"""Problem 6: credentials embedded in source code, found and redacted.

A candidate value comes with its context: the name it is assigned to, an address, a header,
an option, a comment or a key block.  Characters per subword under a public vocabulary tell
unnatural strings from words; what counts as unnatural enough depends on the context.  Where
the name says it is a password, words count too unless they are a placeholder or a reference;
without a name, only strings that are unnatural and have no ordinary explanation count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

# Words that name a credential; "key", "token" and "auth" need company or an unnatural value.
_STRONG = r"pass(?:word|wd|phrase|code)?|pwd|secrets?|credentials?|api[_.-]?key|access[_.-]?key|access[_.-]?token|auth[_.-]?token|bearer[_.-]?token|refresh[_.-]?token|session[_.-]?token|api[_.-]?token|signing[_.-]?key|encryption[_.-]?key|private[_.-]?key|secret[_.-]?key|client[_.-]?secret|hook[_.-]?secret|db[_.-]?pass"
_WEAK = r"token|auth|key|dsn|salt|cookie|jwt|bearer"
# Endings that turn a credential's name into a setting about it.
_SETTING = re.compile(r"(?i)(?:limit|level|name|path|mode|file|type|ttl|count|size|id|url|uri|length|expiry|expires|prefix|policy|field|header|env|var|hash|digest|prompt|label|hint|index|store|provider|class|error|message)s?$")
_NAME = r"[\"'`]?(?P<name>[A-Za-z_][\w.-]*)[\"'`]?"
_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
_ASSIGN = re.compile(_NAME + r"(?:[ \t]*\[\])?[ \t]*(?::[ \t]*[&\w<>\[\]' ]+?[ \t]*=|:=|=>|=|:|\bis\b|\bwas\b|\*/)\s*(?:\(\s*)?(?:f|r|b|u)?(?P<value>" + _QUOTED + r")")
_MORE = re.compile(r"\s*(?:\+|\\|\.\.)?\s*(" + _QUOTED + r")")
_CONFIG = re.compile(r"^[ \t]*(?:export\s+|set\s+|-\s+|\#\s*|//\s*|;\s*)?" + _NAME + r"\s*(?::|=|\bis\b)[ \t]*(?P<value>[^\s\"'`|>&{\[][^\n\"]*?)[ \t\r]*$", re.M)
_SPOKEN = re.compile(r"(?i)(?P<name>(?:\w+[ _.-])?(?:" + _STRONG.replace("[_.-]?", "[ _.-]?") + r"|token|key))\s+(?:was|is|used to be|:|=)\s+(?P<value>[^\s,;\"'`]+)")
_URL = re.compile(r"[A-Za-z][\w+.-]*://(?P<user>[^\s/:@\"'`<>]*):(?P<value>[^\s\"'`<>]+?)@(?=[\w.\[-]+(?:[:/?\"'`\s,;)]|$))")
_QUERY = re.compile(r"(?i)[?&](?:[\w-]*(?:api_?key|access_?key|access_?token|auth_?token|token|secret|password|passwd|pwd|signature|sig|key))=(?P<value>[^&\s\"'`<>#)]+)")
_HEADER = re.compile(r"(?i)(?:\b(?:proxy-)?authorization\b[\"']?\s*[:=,]\s*[\"']?(?:(?:bearer|basic|token|digest)\s+)?|\bx-[\w-]*(?:auth|token|key|secret)[\w-]*[\"']?\s*[:=,]\s*[\"']?|(?<=[\"'`])(?:bearer|basic)\s+)(?P<value>[^\s\"'`,;]+(?: [a-z]+)*)")
_OPTION = re.compile(r"(?i)(?<![\w-])(?:--?(?:[\w-]*(?:password|passwd|pass|token|secret|api-?key|access-?key))(?:\s+|=)(?P<q>[\"']?)(?P<value>[^\s\"']+)|(?:-u|--user)(?:\s+|=)[\"']?[\w.-]+:(?P<value2>[^\s\"']+))")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<body>(?:(?!-----END)[\s\S])*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|(?=-----)|\Z)")
# Lines of a key's body at the start of a chunk, with the last short one and the END marker if they follow.
_PEM_REST = re.compile(r"(?:[ \t]*\r?\n|[ \t\"'#/*+]*[A-Za-z0-9+/=]{16,}(?:\\[nr])*[\"'+,;\\ \t]*\r?(?:\n|\Z))*(?:[ \t\"'#/*+]*[A-Za-z0-9+/=]*(?:\\[nr])*[\"'+,;\\ \t]*\s*[ \t\"'#/*+]*-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)?")
_FREE = re.compile(r"(?<![\w/+=.-])[A-Za-z0-9][\w+/=.:~*!%$-]{15,}(?![\w])")
# Placeholders and references.
_PLACEHOLDER = re.compile(
    r"(?i)^(?:[x*#•._-]+|null|none|nil|undefined|true|false|yes|no|empty|unset|todo|tbd|n/?a|dummy|fake|sample|test|example|placeholder|default|redacted|removed|masked|hidden|omitted|"
    r"change[_ -]?(?:me|it|this)\w*|replace[_ -]?(?:me|this|with)?.*|insert[_ -].*|enter[_ -].*|fill[_ -]?(?:in|me).*|your[_ -].*|my[_ -](?:password|secret|token|key)|put[_ -].*|(?:example|sample|dummy|test|fake)[_ -]?(?:key|token|secret|password|value|credential)s?|"
    r"(?:api[_ -]?key|password|passwd|secret|token|credential|key)s?(?:[_ -]?here)?|.*[_ -](?:goes[_ -])?here|\.\.\.|x{3,}.*)$"
)
_REFERENCE = re.compile(
    r"(?i)^(?:\$\{?[\w.:-]+.*|%[\w.]+%|\$\(.*|\{\{.*|<[^>]*>|\[[^\]]*\]|!\w+.*|(?:vault|ref|env|secret|ssm|arn|kms|sops|op|file|keyring|aws|gcp|azure)[:!].*|@\w+[:./].*|\*\w+$|&\w+$|"
    r"(?:process\.env|os\.environ|os\.getenv|getenv|system\.getenv|env|config|settings|secrets?|vault|args|opts|options|self|this|ctx|request|params|std::env)(?:[.\[(:]).*|[A-Za-z_][\w.]*\(.*\)|(?:/|\./|~/)[\w./-]+|https?://.*)$"
)
# Names and shapes of ordinary random-looking strings.
_ORDINARY_NAME = re.compile(r"(?i)(?:commit|sha\d*|hash|digest|etag|integrity|checksum|md5|crc|uuid|guid|row_?id|build_?id|revision|rev|version|public_?key|pub_?key|fingerprint|certificate|cert|nonce|trace_?id|request_?id|image|path|url|id)$")
_ORDINARY = re.compile(r"(?i)^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{128}|[0-9a-f]{7,12}|[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}|sha\d+[-:].*|md5[-:].*|[\d.,:_/ -]+|data:.*|[\w.-]+@[\w.-]+)$")
# Forms that only tokens have.
_TOKEN_FORM = re.compile(r"^(?:eyJ[\w-]{8,}\.[\w-]{6,}\.[\w-]{6,}|[a-z]{2,5}_(?:live|test|prod|sk|pk)_[A-Za-z0-9]{14,}|(?:gh[pousr]|glpat|xox[abpr]|sk|pk|rk|npm|pypi|dop|shpat|hf)[_-][\w-]{16,}|AKIA[A-Z0-9]{16}|AIza[\w-]{30,})$")
_HEX = re.compile(r"(?i)^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{128})$")
_STRING = re.compile(_QUOTED)
# Words, with small numbers, joined by marks or capitals: identifiers, file names, versions of something.
_WORDS = re.compile(r"^(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[A-Za-z](?![A-Za-z]))\d{0,4}+[._/:+,@=*-]*+)+[a-z]?$")
_NAMED = re.compile(r"([A-Za-z_][\w.-]*)[\"'`]?\s*(?::[ \t]*[&\w<>\[\]' ]+?[ \t]*=|:=|=>|=|:|\bis\b)\s*(?:\(\s*)?[\"'`]?$")
# A string without a telling name has this many characters at least, of two kinds among small and large letters, digits and marks.
FREE_LENGTH, FREE_KINDS = 10, 2
#: A literal without a telling name that is longer than this, pieces joined, is encoded data and no credential.
DATA_LENGTH = 200
_LAST_MARK = r"(?s).*-----(BEGIN|END) (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
#: Below so many characters per subword a string is unnatural; words have four and more.
UNNATURAL = 2.2
#: File types without a syntax of their own for strings: values stand bare.
_BARE = re.compile(r"(?i)\.(?:ya?ml|properties|ini|cfg|conf|env|toml|sh|bash|zsh|md|txt|rst|json)$|(?:^|/)\.env")


def chars_per_subword(value: str, folder: str | None = None) -> float:
    from .tokenizer import byte_bpe

    return len(value) / max(1, len(byte_bpe(folder=folder).encode_ordinary(value)))


def _words(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


_STRONG_RE = re.compile(r"(?:^|[_.-])(?:" + _STRONG + r")$")
_WEAK_RE = re.compile(r"(?:^|[_.-])(?:" + _WEAK + r")$")


def _rank(name: str) -> int:
    """2 if the name says credential, 1 if it may, 0 if not."""
    n = _words(name)
    if _SETTING.search(n) or _ORDINARY_NAME.search(n):
        return 0
    if _STRONG_RE.search(n):
        return 2
    return 1 if _WEAK_RE.search(n) else 0


def _empty(value: str, folder=None) -> bool:
    """A placeholder or a reference; marks that may begin a reference do not make one of an unnatural string."""
    v = value.strip()
    if len(v) < 4 or _PLACEHOLDER.match(v) or v.startswith("# "):
        return True
    return bool(_REFERENCE.match(v)) and not (v[0] in "!*/&@" and " " not in v and ":" not in v and _unnatural(v, folder))


def _unnatural(value: str, folder) -> bool:
    return len(value) >= 8 and chars_per_subword(value, folder) < UNNATURAL and not _ORDINARY.match(value)


def _free(v: str, folder) -> bool:
    """An unnatural string that needs no name to be one: no words, path, address, pattern, markup or call."""
    if len(v) < FREE_LENGTH or re.search(r"\s|://|\\|[<>{}()\[\]|]|^[./#@&$%]", v):
        return False
    if sum(bool(re.search(x, v)) for x in ("[a-z]", "[A-Z]", r"\d", r"[^\w]")) < FREE_KINDS:
        return False
    return not _WORDS.match(v) and not _empty(v, folder) and _unnatural(v, folder)


def find(text: str, path: str | None = None, folder: str | None = None, inside: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, rule) of the credentials in a text, in characters, without overlaps.

    With inside, an earlier chunk of the file left a private key block open; what goes on with it is "rest".
    """
    spans: list[tuple[int, int, str]] = []
    if inside and (body := _PEM_REST.match(text)).group().strip():
        spans.append((0, body.end(), "rest"))

    def add(a, b, rule):
        if b > a and not any(x < b and a < y for x, y, _ in spans):
            spans.append((a, b, rule))

    low = text.lower()
    if "private key" in low:
        for m in _PEM.finditer(text):
            body = re.sub(r"\\[nrt]|[\s\"'+,]", "", m["body"])
            if not re.fullmatch(r"[.x*…]*|.*(?:redacted|placeholder|your.?key).*", body, re.I):
                add(m.start(), m.end(), "private key")
    if "://" in text:
        for m in _URL.finditer(text):
            if not _empty(m["value"], folder):
                add(m.start("value"), m.end("value"), "address")
        for m in _QUERY.finditer(text):
            if not _empty(m["value"], folder) and _unnatural(m["value"], folder):
                add(m.start("value"), m.end("value"), "query")
    if re.search("auth|bearer|basic |x-", low):
        for m in _HEADER.finditer(text):
            v = m["value"].rstrip(")>")
            if v.lower() in ("bearer", "basic", "token") or _empty(v, folder):
                continue
            if v.lower().startswith(("basic ", "bearer ")) or chars_per_subword(v, folder) < 3 or re.search(r"[\d!?#*%-]", v):
                add(m.start("value"), m.start("value") + len(v), "header")
    if re.search(r"pass|pwd|secret|credential|key|token|auth|dsn|salt|cookie|jwt|bearer", low):
        for m in _ASSIGN.finditer(text):
            rank = _rank(m["name"])
            raw = m["value"]
            value = raw[1:-1]
            if not rank or _empty(value, folder):
                continue
            if rank == 1 and not (_TOKEN_FORM.match(value) or _HEX.match(value) or _unnatural(value, folder) and " " not in value and "://" not in value and len(value) >= 12):
                continue
            if re.search(r"\$\{|\{\w*\}|%s", value) or value.startswith(("-----BEGIN PUBLIC", "-----BEGIN CERT")):
                continue
            add(m.start("value") + 1, m.end("value") - 1, "assignment")
            more = _MORE.match(text, m.end())
            while more and ("\n" in more.group() or "+" in more.group()):  # the rest of a literal in pieces
                add(more.start(1) + 1, more.end(1) - 1, "rest")
                more = _MORE.match(text, more.end())
        if path is None or _BARE.search(path):
            for m in _CONFIG.finditer(text):
                rank, value = _rank(m["name"]), m["value"].strip().rstrip(",;")
                if not rank or _empty(value, folder) or value[-1:] in "{[(|>":
                    continue
                if rank == 1 and not (_TOKEN_FORM.match(value) or _HEX.match(value) or _unnatural(value, folder) and len(value) >= 12):
                    continue
                add(m.start("value"), m.start("value") + len(value), "setting")
        for m in _SPOKEN.finditer(text):
            start = text.rfind("\n", 0, m.start()) + 1
            if re.search(r"//|\#|/\*|^\s*\*|--|\"\"\"|<!--|^\s*[-*] ", text[start : m.start() + 1]):
                value = m["value"].rstrip(".,)") if not re.search(r"[!?]$", m["value"]) else m["value"]
                if not _empty(value, folder) and "(" not in value and not re.fullmatch(r"[A-Za-z]+", value) and (chars_per_subword(value, folder) < 3.2 or re.search(r"\d", value)):
                    add(m.start("value"), m.start("value") + len(value), "comment")
        for m in _OPTION.finditer(text):
            k = "value" if m["value"] else "value2"
            if not _empty(m[k], folder) and not m[k].startswith("-"):
                add(m.start(k), m.end(k), "option")
    def ordinary(at):
        name = _NAMED.search(text[text.rfind("\n", 0, at) + 1 : at])
        return name and (_ORDINARY_NAME.search(_words(name[1])) or _SETTING.search(_words(name[1])))

    for m in _FREE.finditer(text):
        v = m.group().rstrip(".:=")
        if _TOKEN_FORM.match(v) and not ordinary(m.start()):
            add(m.start(), m.start() + len(v), "token form")
    run: list = []  # literals with nothing but white space or a joining mark between them are one string
    for m in [*_STRING.finditer(text), None]:
        if run and (m is None or not re.fullmatch(r"\s*(?:[+\\.]\s*)*", text[run[-1].end() : m.start()])):
            if sum(len(r.group()) - 2 for r in run) <= DATA_LENGTH and not ordinary(run[0].start()):
                for r in run:
                    if _free(r.group()[1:-1], folder):
                        add(r.start() + 1, r.end() - 1, "unnatural")
            run = []
        if m is not None:
            run.append(m)
    return sorted(spans)


def redact(text: str, spans) -> str:
    """The text with every span masked by as many asterisks: offsets, line ends and escapes stay in place."""
    out, at = [], 0
    for a, b, _ in spans:
        out.append(text[at:a])
        out.append(re.sub(r"\\.|[^\r\n]", lambda m: m.group() if m.group()[0] == "\\" and m.group()[1] in "nr" else "*" * len(m.group()), text[a:b]) if "-----" in text[a:b] or "\n" in text[a:b] else "*" * (b - a))
        at = b
    return "".join(out) + text[at:]


_SCHEMA = "chunk_id bigint, line_no int, start int, end int, rule string"


def findings(chunks: DataFrame, folder: str | None = None) -> DataFrame:
    """Every credential as chunk_id, 1-based line (split at "\\n") where it begins, place in characters and rule.

    Null and empty texts have none; repeated rows of a chunk_id give each finding once, since
    only the findings are shuffled, never the texts.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for chunk_id, path, text in pdf.itertuples(index=False, name=None):
                for a, b, rule in find(text, path, folder):
                    if rule == "rest":
                        continue
                    rows.append((chunk_id, text.count("\n", 0, a) + 1, a, b, rule))
            yield pd.DataFrame(rows, columns=["chunk_id", "line_no", "start", "end", "rule"])

    c = chunks.where("chunk_id is not null and text <> ''").select("chunk_id", common.path_of(F.col("rel_path"), F.col("context_header")).alias("path"), "text")
    return common.spread(c).mapInPandas(scan, _SCHEMA).distinct()


def redacted(chunks: DataFrame, folder: str | None = None) -> DataFrame:
    """(chunk_id, found, text): each chunk once, its text with credentials masked in place; null stays null."""

    def mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for chunk_id, path, text, inside in pdf.itertuples(index=False, name=None):
                spans = find(text, path, folder, inside is True) if text else []
                rows.append((chunk_id, len(spans), redact(text, spans) if spans else text))
            yield pd.DataFrame(rows, columns=["chunk_id", "found", "text"])

    path = common.path_of(F.col("rel_path"), F.col("context_header")).alias("path")
    row = F.struct("indexed_at", "text", path)
    one = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.max(row).alias("r")).select("chunk_id", "r.path", "r.text")
    if not {"file_id", "chunk_index"} <= set(chunks.columns):  # chunks by themselves
        return one.withColumn("inside", F.lit(False)).select("chunk_id", "path", "text", "inside").mapInPandas(mask, "chunk_id bigint, found int, text string")
    # what the last marker before a chunk of the file is; only marks and places travel, never texts
    marks = chunks.where("chunk_id is not null and file_id is not null").select("chunk_id", F.struct("indexed_at", "file_id", "chunk_index", F.nullif(F.regexp_extract("text", _LAST_MARK, 1), F.lit("")).alias("mark")).alias("r"))
    marks = marks.groupBy("chunk_id").agg(F.max("r").alias("r")).select("chunk_id", "r.file_id", "r.chunk_index", "r.mark")
    before = Window.partitionBy("file_id").orderBy("chunk_index", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select("chunk_id", (F.last("mark", ignorenulls=True).over(before) == "BEGIN").alias("inside")).where("inside")
    one = one.join(marks, "chunk_id", "left").select("chunk_id", "path", "text", F.coalesce("inside", F.lit(False)).alias("inside"))
    return one.mapInPandas(mask, "chunk_id bigint, found int, text string")


def found(chunks: DataFrame, folder: str | None = None) -> DataFrame:
    """(chunk_id, line_no) of the lines on which a credential begins."""
    return findings(chunks, folder).select("chunk_id", "line_no").distinct()
