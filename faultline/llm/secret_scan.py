"""Secret scans by assignment-aware lexing.

A text is lexed once into strings, names, operators and lines, as source and
configuration files have them.  Every assignment gives a target name and the
literals of its right side: quoted strings and their concatenation, whole-line
unquoted values, element texts, ``name``/``value`` pairs.  A name on the right
side brings the literals it was last given (constant propagation), so a literal
is judged by every name it reaches.  Its score is the target's sensitivity times
the literal's strength; from ``THRESHOLD`` on it is a secret.

The base patterns (assign, access, hex) are matched beside it and always kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import ship

THRESHOLD = 0.5
KINDS = ("assign", "access", "hex", "literal")
SPANS = "array<struct<kind:string,start:int,end:int,name:string,score:double>>"
_ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are matched whole, so a shorter run can't hold one
_BASE_STEMS = ("passw", "secret", "token", "api")

#: A sensitive name holds one of these.
STEMS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer")
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pass": 0.8, "secret": 1.0, "secrets": 0.9, "token": 0.95,
    "apikey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "privatekey": 1.0, "key": 0.45, "credential": 0.9, "credentials": 0.9, "cred": 0.8, "creds": 0.8,
    "auth": 0.7, "authorization": 0.9, "bearer": 0.9,
}
#: Words that make a ``key`` a secret one.
KEYED = {"api", "access", "private", "signing", "encryption", "master", "auth", "account", "client", "service", "deploy", "license", "storage", "session"}
#: Words of names that hold something about a secret, not the secret.
ABOUT = {
    "public": 0.0, "id": 0.4, "name": 0.3, "file": 0.3, "path": 0.3, "dir": 0.2, "url": 0.4, "uri": 0.4, "length": 0.0, "len": 0.0, "count": 0.0, "size": 0.0,
    "max": 0.0, "min": 0.0, "num": 0.0, "type": 0.2, "ttl": 0.0, "expiry": 0.0, "expires": 0.0, "label": 0.0, "hint": 0.0, "prompt": 0.0, "field": 0.2,
    "policy": 0.0, "regex": 0.0, "pattern": 0.0, "format": 0.2, "index": 0.2, "primary": 0.2, "foreign": 0.0, "sort": 0.0, "partition": 0.2,
}
_PLACEHOLDER = re.compile(r"(?i)\$\{|\{\{|%\(|<[^<>]*>|^(?:x+|\*+|\.+|-+|_+|0+|(?:null|none|nil|true|false|undefined|todo|tbd))$|change.?me|your[_-]|example|placeholder|redacted|dummy|insert.?here|not.?set")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

_LEX = re.compile(
    r"""
    (?P<escaped>\\.)
  | (?P<text3>\"\"\"(?P<in3a>.*?)\"\"\"|'''(?P<in3b>.*?)''')
  | "(?P<double>(?:[^"\\\n]|\\.)*+)"
  | (?<![A-Za-z0-9_])'(?P<single>(?:[^'\\\n]|\\.)*+)'
  | `(?P<back>(?:[^`\\\n]|\\.)*+)`
  | \$\{?(?P<ref>[A-Za-z_][A-Za-z0-9_]*)\}?
  | <(?P<element>[A-Za-z][A-Za-z0-9_.-]*+)>(?P<body>[^<\s]++)</(?P=element)>
  | (?P<name>[A-Za-z_][A-Za-z0-9_]*+(?:[.-][A-Za-z0-9_]++)*+)
  | (?P<compare>==+|!=|<=|>=|->|::)
  | (?P<assign>:=|=>|\?=|\+=|=|:)
  | (?P<line>\n)
  | (?P<mark>[+,;(){}\[\]])
  | (?P<number>[0-9]+)
    """,
    re.VERBOSE | re.DOTALL,
)
_VALUE = re.compile(r"[ \t]*([^\s\"'`#;,(){}\[\]]+)[ \t]*(?=$|[\n#;])")
_STARTS = frozenset(("export", "set", "env", "arg", "const", "let", "var", "val", "final", "static", "public", "private", "def", "local", "readonly"))
Literal = tuple[int, int, str]  # start, end, value


def sensitivity(name: str) -> float:
    """How likely a name holds a secret, from its words."""
    words = [w.lower() for w in _WORD.findall(name)]
    best = 0.0
    for i, w in enumerate(words):
        s = SENSITIVE.get(w, 0.0)
        if w in ("key", "keys") and i and words[i - 1] in KEYED | {"secret"}:
            s = 1.0
        best = max(best, s)
    for w in words:
        best *= ABOUT.get(w, 1.0)
    return best


def strength(value: str) -> float:
    """How likely a literal is a secret: total Shannon information of its characters, and their classes."""
    n = len(value)
    if n < 6 or _PLACEHOLDER.search(value):
        return 0.0
    bits = -sum(c * math.log2(c / n) for c in Counter(value).values())
    classes = sum(any(t(c) for c in value) for t in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, bits / 24) * (1.0 if classes > 1 else 0.6) * (0.3 if any(c.isspace() for c in value) else 1.0)


def _lexed(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, value) of each token; the place of a string or element is that of its content."""
    for m in _LEX.finditer(text):
        kind = m.lastgroup
        if kind == "text3":
            kind = "in3a" if m["in3a"] is not None else "in3b"
        if kind in ("in3a", "in3b", "double", "single", "back"):
            yield "string", *m.span(kind), m[kind]
        elif kind == "body":
            yield "element", *m.span("body"), m["element"]
        elif kind != "escaped":
            yield kind, *m.span(kind), m[kind]


class Assignment:
    """A target name, the literals on its right side, and the earlier assignments it takes values from."""

    __slots__ = ("name", "literals", "uses", "weight")

    def __init__(self, name: str, literals: list[Literal], uses: list[int]):
        self.name, self.literals, self.uses = name, literals, uses
        self.weight = sensitivity(name)


def assignments(text: str) -> list[Assignment]:
    """Every assignment in order; a used name stands for its last assignment before."""
    tokens = list(_lexed(text))
    known: dict[str, int] = {}
    out: list[Assignment] = []
    called: str | None = None  # the literal of the last name: ... pair
    for i, (kind, start, end, value) in enumerate(tokens):
        if kind == "element":
            out.append(Assignment(value, [(start, end, text[start:end])], []))
            continue
        if kind != "assign" or i == 0:
            continue
        at = i - 1
        if tokens[at][3] == "]" and at:  # settings["password"] = ...
            at -= 1
        if tokens[at][0] not in ("name", "string", "ref"):
            continue
        target = tokens[at][3]
        if value == "=" and at >= 2 and tokens[at - 1][3] == ":" and tokens[at - 2][0] == "name":  # name: type = ...
            target = tokens[at - 2][3]
        if not target or len(target) > 200:  # a sentence, not a name
            continue
        literals, uses = _operands(text, tokens, i, at, known)
        if value == "+=" and target in known:
            uses.append(known[target])
        found = Assignment(target, literals, uses)
        last = target.rpartition(".")[2]
        if last.lower() in ("name", "key") and literals:
            called = literals[0][2]
        elif last.lower() == "value" and called is not None:
            other = sensitivity(called)
            if other > found.weight:
                found.name, found.weight = called, other
            called = None
        known[target] = known[last] = len(out)
        out.append(found)
    for a in reversed(out):  # a name that reaches a more sensitive one is as sensitive
        for k in a.uses:
            if a.weight > out[k].weight:
                out[k].name, out[k].weight = a.name, a.weight
    return out


def _operands(text: str, tokens: list, i: int, at: int, known: dict[str, int]) -> tuple[list[Literal], list[int]]:
    """Literals and used assignments of the right side behind token ``i``, which ends at the next assignment at the latest."""
    here = tokens[at][1]
    line = text.rfind("\n", max(0, here - 80), here) + 1
    lead = text[line:here].strip(" \t-\"'").lower() if line or here < 80 else "?"
    whole = _VALUE.match(text, tokens[i][2]) if not lead or lead in _STARTS else None
    if whole:  # name = value on a line of its own
        name = whole[1].strip("${}")
        if name in known:
            return [], [known[name]]
        return ([] if whole[1].startswith("$") else [(whole.start(1), whole.end(1), whole[1])]), []
    literals, uses = [], []
    j, n, depth = i + 1, len(tokens), 0
    while j < n:
        kind, start, end, value = tokens[j]
        follows = tokens[j + 1] if j + 1 < n else ("line", 0, 0, "\n")
        if kind in ("string", "name", "ref"):
            if follows[0] == "assign":
                break
            if kind == "string":
                if not (depth and re.fullmatch(r"[A-Z][A-Z0-9_]*", value)):  # the name of a setting, not its value
                    literals.append((start, end, value))
            elif follows[3] != "(":
                if value in known:
                    uses.append(known[value])
                if not depth and follows[0] != "mark":
                    break
        elif value == "(":
            depth += 1
        elif value == ")" and depth:
            depth -= 1
        elif not (value == "+" or (depth and (kind == "line" or value == ","))):
            break
        j += 1
    return literals, uses


def base_secrets(text: str, low: str) -> list[tuple[str, int, int]]:
    out = []
    if any(s in low for s in _BASE_STEMS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def secrets_of(text: str | None) -> list[tuple[str, int, int, str | None, float]]:
    """(kind, start, end, target name, score) of a text, by start, then kind; code points, end exclusive.

    A literal that overlaps a base span is that span already and isn't listed.
    """
    if not text:
        return []
    low = text.lower()
    base = base_secrets(text, low)
    found: dict[tuple[int, int], tuple[float, str]] = {}
    if ("=" in text or ":" in text or "</" in text) and any(s in low for s in STEMS):
        for a in assignments(text):
            score = round(a.weight * strength("".join(v for _, _, v in a.literals)), 6) if a.literals and a.weight >= THRESHOLD else 0.0
            if score >= THRESHOLD:
                for start, end, _ in a.literals:
                    if end - start >= 3 and score > found.get((start, end), (0.0, ""))[0]:
                        found[start, end] = score, a.name
    out = [(k, s, e, None, 1.0) for k, s, e in base]
    taken, at = sorted((s, e) for _, s, e in base), 0
    reach = 0  # end of the furthest base span that starts at or before this literal
    for (start, end), (score, name) in sorted(found.items()):
        while at < len(taken) and taken[at][0] <= start:
            reach = max(reach, taken[at][1])
            at += 1
        if start < reach or (at < len(taken) and taken[at][0] < end):
            continue
        out.append(("literal", start, end, name, score))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, spans: list[tuple[str, int, int, str | None, float]]) -> str:
    """The text with each stretch of overlapping spans replaced by its first kind."""
    parts, at = [], 0
    for kind, start, end, *_ in spans:
        if start >= at:
            parts += (text[at:start], f"[{kind.upper()}]")
        at = max(at, end)
    return "".join(parts) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``_secrets`` (kind, start, end, name, score) and ``_clean`` (the text without them).

    Null text: no secrets, ``_clean`` null; empty text: none.  Every row is judged
    by its text alone, so null and repeated ids, copies and ties need no rule.
    Columns of these two names are replaced; no other column is read.  One
    pass over the rows, without a shuffle.
    """
    ship(docs.sparkSession)

    @F.arrow_udf(f"struct<spans:{SPANS},clean:string>")
    def judged(texts: pa.Array) -> pa.Array:
        spans, clean = [], []
        for t in texts:
            text = t.as_py()
            found = secrets_of(text)
            spans.append([{"kind": k, "start": s, "end": e, "name": n, "score": x} for k, s, e, n, x in found])
            clean.append(redacted(text, found) if found else text)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(spans, kind), pa.array(clean, pa.string())], names=["spans", "clean"])

    rows = docs.drop("_secrets", "_clean", "_judged").withColumn("_judged", judged(F.col("text").cast("string")))
    return rows.withColumns({"_secrets": F.col("_judged.spans"), "_clean": F.col("_judged.clean")}).drop("_judged")


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
