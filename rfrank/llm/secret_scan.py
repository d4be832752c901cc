"""Secrets in texts: three exact kinds, and literals that source code or configuration assigns to telling names.

The base kinds are patterns. Beyond them a text is lexed for assignments: name and value in the forms of
programming languages, JSON, YAML, properties and ini files, shell, command lines, markup, calls that set
something, and addresses with credentials. A value is made of literals, joined or side by side, and of names.
A name that stands in a value passes its own literals on (constants are propagated whatever the order of the
statements), so a literal is scored by the most telling name that it reaches and by its own shape.

Every text is looked at by itself, where it lies: one scan, no shuffle, no limit on lengths. Every pattern
is linear in the text: runs are possessive or bounded, and start where a word starts.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_package, text_of

KINDS, ADDED = ("assign", "access", "hex"), "literal"
# The contract's patterns over bytes, so that only ASCII letters have two cases. Of ``access`` and ``hex`` a match
# that is long enough is found as such: their runs have one start.
_ASSIGN = re.compile(
    rb"""(?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr][Dd]|[Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
)
_ACCESS, _HEX = re.compile(rb"AKIA[A-Z0-9]{14,}+"), re.compile(rb"[0-9a-f]{16,}+")
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")

# Parts of names that tell a secret by themselves, those that do in company, and those that deny it.
STRONG = {
    "password", "passwd", "pwd", "passphrase", "passwort", "kennwort", "secret", "token", "apikey", "credential", "credentials", "privatekey",
    "contraseña", "motdepasse", "authtoken", "accesskey", "secretkey", "clientsecret", "passcode", "apitoken", "dbpass", "authorization",
}
WEAK = {"key", "auth", "pass", "pin", "salt", "seed", "bearer", "signature", "cookie", "session", "dsn", "cert"}
COMPANY = {"api", "access", "private", "signing", "encryption", "master", "shared", "account", "storage", "client", "service", "admin", "db", "database", "root", "user", "jwt", "webhook", "x", "aws", "hmac"}
DENY = {
    "name", "names", "id", "ids", "count", "length", "len", "size", "path", "file", "filename", "dir", "url", "uri", "type", "hint", "label", "field", "header",
    "prompt", "policy", "expiry", "expires", "ttl", "timeout", "public", "index", "page", "max", "min", "placeholder", "regex", "pattern", "format", "env", "var", "limit",
}
#: Lower-case beginnings without one of which no name in a text scores: names are made of the words above.
STEMS = ("pass", "pwd", "kennwort", "secret", "token", "key", "credential", "contraseña", "auth", "pin", "salt", "seed", "bearer", "signature", "cookie", "session", "dsn", "cert")
_DUMMY = re.compile(r"(?i)example|change.?me|your[_-]|dummy|placeholder|redacted|insert|todo|foo.?bar|x{4}|\*{3}|\.{3}|<[^>]*>|\$\{|\{\{|%[sd]|^\$")
_PLAIN = re.compile(r"(?i)^(?:true|false|null|none|nil|undefined|yes|no|on|off|str|string|int|bool|bytes|text|required|optional|[0-9]{1,5})$")

_NAME = r"[^\W\d][\w$]*+(?:(?:\.|->|::|-)[^\W\d][\w$]*+){0,8}+"
_HEAD = re.compile(
    rf"""(?<![\w$])(?:(?P<name>{_NAME})(?:\[[ \t]*+["'](?P<key>[^"'\n]++)["'][ \t]*+\])?+|["'](?P<quoted>[^"'\n]++)["'])[ \t]*+(?P<op>:=|=>|={{1,3}}+(?!>)|:(?![:/])|,(?=[ \t]*+["'])|\((?=[ \t]*+(?:["']|{_NAME}[ \t]*+[,)])))[ \t]*+"""
)
_TYPED = re.compile(r"[^\W\d][\w.\[\]|?]*+[ \t]*+=(?!=)[ \t]*+")
_STRING = re.compile(r"""[rRbBuUfF]{0,2}+(?:\"\"\"((?:[^"\\]|\\.|"(?!""))*+)\"\"\"|'''((?:[^'\\]|\\.|'(?!''))*+)'''|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\\n]|\\.)*+)`)""", re.S)
_REFERENCE, _BARE, _SCHEME = re.compile(_NAME), re.compile(r"""[^\s"'`,;<>(){}\[\]#&=]++={0,2}+"""), re.compile(r"(?i)(?:bearer|basic|token)[ \t]++")
_JOIN = re.compile(r"""\s*+(?:\+|\.\.?|&|\\\n)\s*+|[ \t]*+(?=["'`]|[rRbBuUfF]{1,2}["'])""")
_CALL, _COMMA = re.compile(r"\([ \t]*+"), re.compile(r"[ \t]*+,[ \t]*+")
_URL = re.compile(r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\s:/@\"'<>]*+:([^\s/@\"'<>]++)@")
_FLAG = re.compile(r"(?<!\S)--?([a-z][\w-]*+)[ \t]++[\"']?+([^\s\"'-][^\s\"']*+)")
_MARKUP = re.compile(rf"<({_NAME})(?:\s[^<>]*+)?+>\s*+([^<>\n]++)</")
_WORDS = re.compile(r"[^\W\d_]\d*+(?:(?<![^\W\d_A-Z])[A-Z]*+(?![a-z])|[^\W\d_A-Z]*+)\d*+")


class Assignment(NamedTuple):
    """A name, the literals of its value as (start, end), the names in it, and whether the literals are quoted."""

    name: str
    literals: tuple[tuple[int, int], ...]
    names: tuple[str, ...]
    quoted: bool = True


def words_of(name: str) -> list[str]:
    """A name's words in lower case: ``clientSecretKey``, ``CLIENT_SECRET_KEY`` and ``client-secret-key`` have the same."""
    parts = re.split(r"[\W_]+", re.sub(r"([a-zà-ÿ0-9])([A-Z])|([A-Z])([A-Z][a-zà-ÿ])", r"\1\3_\2\4", name))
    return [p.lower().rstrip("0123456789") for p in parts if p and not p.isdigit()]


def name_score(name: str) -> float:
    """How telling a name is: 3 of a secret, 2 if it takes company, 1 perhaps, below 0 of something else."""
    words = words_of(name)[-4:]
    if not words:
        return 0.0
    joined = {a + b for a, b in zip(words, words[1:], strict=False)}
    found = set(words)
    if found & STRONG or joined & STRONG:
        score = 3.0
    elif found & WEAK:
        score = 2.0 if found & COMPANY else 1.0
    else:
        return 0.0
    return score - 4 * (words[-1] in DENY or "public" in found)


def literal_score(value: str, quoted: bool) -> float:
    """How much a literal looks like a secret by its length, letters and variety."""
    n = len(value)
    if n < 4 or _PLAIN.match(value):
        return -5.0
    if _DUMMY.search(value):
        return -4.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    if entropy < 1.5:
        return -4.0
    digit, letter = any(c.isdigit() for c in value), any(c.isalpha() for c in value)
    other = any(not c.isalnum() and not c.isspace() for c in value)
    score = 0.5 * (digit + other) + (n >= 8) * 0.5 + (n >= 16 and entropy >= 3 and digit and letter) * 1.5
    if any(c.isspace() for c in value):
        score -= 1 if any(not w.isalpha() and any(c.isalpha() for c in w) for w in value.split()) else 2
    return score if quoted or digit and letter or other and n >= 8 and letter else score - 3


THRESHOLD = 3.0


def _value(text: str, at: int) -> tuple[list[tuple[int, int]], list[str], bool, int, bool]:
    """The literals and names of the value at a place, whether literals are quoted, where it ends, and whether it is a call."""
    literals, names, start = [], [], at
    while True:
        if m := _STRING.match(text, at):
            literals.append(m.span(m.lastindex))
        elif m := _REFERENCE.match(text, at):
            if call := _CALL.match(text, m.end()):  # of a call, its literal arguments
                at = call.end()
                while m := _STRING.match(text, at):
                    literals.append(m.span(m.lastindex))
                    comma = _COMMA.match(text, m.end())
                    at = comma.end() if comma else m.end()
                return literals, names, True, at, True
            names.append(m[0])
        else:
            break
        at = m.end()
        join = _JOIN.match(text, at)
        if not join or not join[0].strip() and text[at - 1] not in "\"'`":
            break
        at = join.end()
    if literals:
        return literals, names, True, at, False
    # Without quotes: a scheme and what follows it, a name, or a word of any marks.
    scheme = _SCHEME.match(text, start)
    start = scheme.end() if scheme else start
    if m := _BARE.match(text, start):
        return [m.span()], [m[0]] if names and names[0] == m[0] else [], False, m.end(), False
    return [], names, False, at, False


def assignments(text: str) -> Iterator[Assignment]:
    """The assignments of a text, in order of where their names stand, form by form."""
    at = 0
    while m := _HEAD.search(text, at):
        at = m.end()
        name = m["key"] or m["name"] or m["quoted"]
        if m["op"] == "," and not m["quoted"]:
            continue
        if m["op"] == ":" and (typed := _TYPED.match(text, at)):
            at = typed.end()
        literals, names, quoted, end, call = _value(text, at)
        if m["op"] == "(" and not quoted:  # in brackets a word is a name, or prose
            literals = []
        if call:  # each argument by itself
            yield from (Assignment(name, (span,), ()) for span in literals)
        elif literals or names:
            yield Assignment(name, tuple(literals), tuple(names), quoted)
        if quoted and m["op"] not in ",(":
            at = max(at, end)
    for pattern in (_FLAG, _MARKUP):
        for m in pattern.finditer(text):
            value = m[2].rstrip()
            yield Assignment(m[1], ((m.start(2), m.start(2) + len(value)),), (), pattern is _MARKUP)
    for m in _URL.finditer(text):
        yield Assignment("url_password", (m.span(1),), ())


def _last(name: str) -> str:
    return re.split(r"\.|->|::", name)[-1]


def scored_literals(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals; one that stands in several assignments has its best score.

    A constant counts for the names that its own name is assigned to, over any number of steps: names are
    visited from the most telling one backwards, each once.
    """
    found = list(assignments(text))
    sources, best = defaultdict(list), {}
    for a in found:
        best[_last(a.name)] = max(best.get(_last(a.name), -9.0), name_score(a.name))
        for n in a.names:
            sources[_last(a.name)].append(_last(n))
    reach: dict[str, float] = {}
    for name in sorted(best, key=lambda n: -best[n]):
        todo = [name]
        while todo:
            n = todo.pop()
            if n not in reach:
                reach[n] = best[name]
                todo += sources[n]
    out: dict[tuple[int, int], float] = {}
    for a in found:
        if not a.quoted and a.names and _last(a.names[0]) in best:
            continue  # the word is the name of something assigned
        value = "".join(text[s:e] for s, e in a.literals)
        name = max(reach.get(_last(a.name), 0.0), name_score(a.name))
        score = name + literal_score(value, a.quoted) if name > 0 else -9.0
        for span in a.literals:
            if span[0] < span[1]:
                out[span] = max(out.get(span, -9.0), score)
    return sorted((s, e, score) for (s, e), score in out.items())


def base_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes of the exact kinds, by start, then kind as listed."""
    lowered = raw.lower()
    out = []
    if any(w in lowered for w in _ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(raw) if m.end(1) - m.start(1) >= 12]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in _ACCESS.finditer(raw)]
    out += [("hex", *m.span()) for m in _HEX.finditer(raw)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(raw: bytes) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of a text in UTF-8, in code points."""
    base = base_spans(raw)
    text = raw.decode()
    if base and len(text) != len(raw):
        at = chars = 0
        places = {}
        for p in sorted({p for _, *span in base for p in span}):
            chars += len(raw[at:p].decode())
            at, places[p] = p, chars
        base = [(k, places[s], places[e]) for k, s, e in base]
    more = []
    low = text.lower()
    if "://" in text or any(w in low for w in STEMS):
        # Base spans hold what they cover. Of literals that overlap, the first found is kept.
        taken = sorted((s, e) for _, s, e in base)
        i, until = 0, -1
        for s, e, score in scored_literals(text):
            while i < len(taken) and taken[i][0] < e:
                until = max(until, taken[i][1])
                i += 1
            if score >= THRESHOLD and s >= until:
                more.append((ADDED, s, e))
                until = e
    order = (*KINDS, ADDED)
    return base, sorted(base + more, key=lambda s: (s[1], order.index(s[0])))


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find_secrets(docs: DataFrame, carry: Sequence[Column | str] = ("*",), text_col: str = "text") -> DataFrame:
    """Find secrets in every text.

    Returns one row per input row: ``row`` (a struct of the ``carry`` columns), ``base`` and ``spans``, arrays of
    (kind, start, end) in order of start, then kind: code points, ends exclusive. A base span is the whole match, of
    ``assign`` with the name before the value; ``spans`` holds the base spans and, as ``literal``, the values that the
    lexer adds, without their quotes. An added span overlaps no base span.

    A null text counts as empty and has no spans; repeated rows are treated alike; a text of any length is read
    whole; an empty table gives an empty result. Other columns ride along inside ``row``, whatever their names.
    """
    ship_package(docs.sparkSession)
    source = docs.select(F.struct(*carry).alias("row"), text_of(text_col).alias("text"))
    schema = T.StructType([source.schema["row"], T.StructField("base", _SPANS), T.StructField("spans", _SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def column(spans: list) -> pa.Array:
            return pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in of] for of in spans], kind)

        for b in batches:
            found = [scan(t.as_py()) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), column([f[0] for f in found]), column([f[1] for f in found])], ["row", "base", "spans"])

    return source.mapInArrow(apply, schema)


def written(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in the whole of ``documents``; after the contract's columns ``n_literals``, how many spans the lexer adds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def count(spans: str, kind: str, name: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(name)

    return find_secrets(docs, carry=["doc_id"]).select(
        "row.doc_id",
        *[count("base", k, f"n_{k}") for k in KINDS],
        F.sha2(written("base"), 256).alias("base_sha256"),
        written("spans").alias("spans"),
        count("spans", ADDED, "n_literals"),
    )
