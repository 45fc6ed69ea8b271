"""Secrets in source and configuration text, by assignment-aware lexing.

A lexer reads name-literal pairs in the syntaxes of configuration and source files (name = "x", name: x,
"name": "x", export NAME=x, name := x, name: type = x, table["name"] = x, #define NAME "x", define("NAME", "x"), values in
parentheses, triple quotes, on the next line or in a YAML block, constants joined with + over any lines or side by side
in parentheses, what stands in for a missing value after or, ||, ??, else, a ternary's marks or as a later argument of a
call, and names given another name's value). Constants are propagated through such names to where they are used, before
or after they are defined (in a sum only before); a name holds what it was given last. Calls and dotted names of
variables are no literals. A pair's score comes from how sensitive its target's name is and how random its literal
looks; scores of at least MIN_SCORE give spans of kind `pair`: the literal's run in the expression and the constants
that it is made of, parts under SHORTEST_PART characters left out. Three plain patterns are always reported: assign,
access and hex. Not read: marked-up text (XML), back quotes, and names put together at run time.

Spans are in code points, end exclusive, by start, then kind in this order: assign, access, hex, pair. A null
or empty text has none. Every row gives one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from harbinger.llm import common
from harbinger.llm.pii import digest

KINDS = ("assign", "access", "hex", "pair")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_STEMS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: Parts of sensitive names and how sensitive each is.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "privatekey": 1.0, "accesskey": 1.0, "credential": 0.9, "auth": 0.75, "signature": 0.75, "salt": 0.75, "cookie": 0.75}
#: The names of writers hold `auth`, but alone they are no credentials (authorization is one).
AUTHOR, AUTHOR_WEIGHT = re.compile(r"author(?!i[sz])"), 0.6
#: Literals that stand for no secret.
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|true|false|changeme|example.*|your.*|todo|redacted|placeholder|<.*>|\$\{.*\}|%\(.*\)s)$")
MIN_SCORE = 0.6
SHORTEST = 8
SHORTEST_PART = 4
#: What is before a value that stands in for a missing one, and names of arguments that are such values.
ELSE, DEFAULTS = ("or", "else"), ("default", "fallback")
#: What may stand before a quote.
_MARKS = ("@", "$", "@$", "$@")
#: First characters of a literal that are kept to tell placeholders.
HEAD = 16

_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
_STRING = {q: re.compile(rf"{q}(?:[^{q}\\\n]++|\\.)*+{q}") for q in "\"'"}
#: What stands between the colon and the equals sign of a typed name (longer ones on one line), and the start of a YAML block.
_TYPE = re.compile(r"[\w\s.\[\]<>,|&?*]{1,120}|[\w \t.\[\]<>,|&?*]++")
_STRING_AHEAD = re.compile(r"""\s*\(?\s*[A-Za-z]{0,2}["']""")
_YAML_BLOCK = re.compile(r"[|>][-+0-9]{0,2}[ \t]*(?=\n)")
_BARE = re.compile(r"[^\s,;\"'(){}\[\]]*+")
_TOKEN = re.compile(
    rf"""(?P<quote>["'])|(?P<name>{_NAME})|(?P<op>:=|=>|==|!=|<=|>=|[=:+,;(){{}}\[\]])|(?P<line>\n)|(?P<other>[^\s"'A-Za-z_:=+,;(){{}}\[\]]+)""", re.A
)


def sensitivity(name: str) -> float:
    flat = re.sub(r"[^a-z]", "", name.lower())
    rest = AUTHOR.sub(" ", flat)
    return max((w for part, w in SENSITIVE.items() if part in rest), default=AUTHOR_WEIGHT if rest != flat else 0.0)


def randomness(counts: Counter[str], n: int) -> float:
    """0 to 1: bits a character against those of a random string, with a share for mixed kinds of characters."""
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in counts)
    return min(1.0, bits / min(4.0, math.log2(n)) * 0.7 + 0.1 * kinds)


class Literal:
    """Length, ends and counts of characters, all that a score needs: constants joined through names can double with
    every line, so their text is never built. Its text is from i to j, or in the literals of `of` and, in its own
    expression, the span `own`."""

    __slots__ = ("n", "head", "tail", "counts", "random", "i", "j", "own", "of")

    def __init__(self, text: str, i: int, j: int):
        self.n, self.head, self.tail = j - i, text[i : min(j, i + HEAD)], text[max(i, j - 2) : j]
        self.i, self.j = i, j
        self.own: tuple[int, int] | None = (i, j)
        self.of: list[Literal] = []
        self.counts: Counter[str] | None = None
        self.random: float | None = None

    def placeholder(self) -> bool:  # a long run of x, * or . has too few bits to score
        return bool(PLACEHOLDER.match(self.head if self.n <= HEAD else f"{self.head}-{self.tail}"))

    def add(self, other: Literal) -> None:
        if self.n < HEAD:
            self.head = (self.head + other.head)[:HEAD]
        self.tail = (self.tail + other.tail)[-2:]
        self.n += other.n
        self.counts.update(other.counts)
        self.random = None


def tokens(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, value, start, end); a string's are those of what its quotes enclose, doubled quotes and all. A quote that its
    line does not close is passed over; further ones of its kind in the line are then escaped and not closed either. What
    triple quotes enclose over several lines is a string and then, as it may be a file of its own, read by tokens too."""
    at, unclosed, triple, closing = 0, {'"': 0, "'": 0}, {'"': True, "'": True}, set()
    while m := _TOKEN.search(text, at):
        kind, value = m.lastgroup, m[0]
        i, at = m.span()
        if kind != "quote":
            yield kind, value, i, at
        elif i in closing:
            at = i + 3
        elif i >= unclosed[value]:
            if triple[value] and text.startswith(value * 3, i):
                end = text.find(value * 3, i + 3)
                if end >= 0:
                    yield "string", text[i + 3 : end], i + 3, end
                    at = end + 3
                    if "\n" in text[i + 3 : end]:
                        at = i + 3
                        closing.add(end)
                        yield "line", "\n", at, at
                    continue
                triple[value] = False  # none closes further on
            if whole := _STRING[value].match(text, i):
                while whole:
                    at = whole.end()
                    whole = _STRING[value].match(text, at)
                yield "string", text[i + 1 : at - 1], i + 1, at - 1
            else:
                end = text.find("\n", i)
                unclosed[value] = end if end >= 0 else len(text)


def yaml_block(text: str, key: int, at: int) -> tuple[int, int]:
    """The span of the lines after the one that `at` lies in that are deeper than the line of `key`, without the white
    space around them."""
    line = text.rfind("\n", 0, key) + 1
    depth = len(text[line:key]) - len(text[line:key].lstrip(" "))
    begin = end = text.find("\n", at) + 1
    while 0 < end < len(text):
        stop = text.find("\n", end)
        stop = len(text) if stop < 0 else stop
        own = text[end:stop]
        if own.strip() and len(own) - len(own.lstrip(" ")) <= depth:
            break
        end = stop + 1
    whole = text[begin:end]
    i = begin + len(whole) - len(whole.lstrip())
    return i, max(i, begin + len(whole.rstrip()))


def variable(name: str) -> bool:
    """A dotted name none of whose parts looks random."""
    return "." in name and not any(any(map(str.isdigit, p)) and any(map(str.islower, p)) and any(map(str.isupper, p)) for p in name.split("."))


def prose(value: str) -> bool:
    """What triple quotes enclose is text to read if it has spaces and no long run without them that holds a digit."""
    return " " in value and not any(len(w) >= 16 and any(map(str.isdigit, w)) for w in value.split())


def pairs(text: str) -> list[tuple[str, Literal]]:
    """Target names and the literals that they get."""
    out: list[tuple[str, Literal]] = []
    known: dict[str, Literal] = {}
    alias: dict[str, str] = {}  # names given a name that is not known yet
    later: list[tuple[int, str]] = []  # pairs whose value is such a name
    previous: list[tuple[str, str, int, int]] = []  # the last three tokens
    joined: Literal | None = None  # the last pair's literal, once it has parts
    named = unknown = False  # whether the last pair's first part is a name, and one that is not known
    chain = ""  # value: the last pair's expression may go on with a plus; plus: a part follows
    typed: tuple[str, int, int] | None = None  # name, end of its colon, and pairs before what follows it
    bare_end = block_end = 0
    wrapped = grouped = False  # whether the value may stand on this line, and whether parentheses hold it
    target: str | None = None  # of the expression that goes on
    commas: list[int] = []  # of the calls that are open in it
    choice = False  # whether it has the mark of a ternary

    def counted(x: Literal) -> Literal:
        if x.counts is None:
            x.counts = Counter(text[x.i : x.j])
        return x

    def holds(target: str, value: Literal | None, name: str | None = None) -> None:
        known.pop(target, None)
        alias.pop(target, None)
        if value:
            known[target] = value
        elif name:
            alias[target] = name

    for kind, value, i, j in tokens(text):
        quoted = text[j : j + 1] in ('"', "'")
        if i < block_end or kind == "other" and value == "\\" and text[j : j + 1] == "\n" or quoted and (kind == "name" and j - i <= 2 and value not in ELSE or kind == "other" and value in _MARKS):
            continue  # a line that goes on, or what stands before a string
        last = previous[-1] if previous else ("", "", 0, 0)
        awaited = len(previous) >= 2 and last[0] == "op" and last[1] in ("=", ":", ":=", "=>") and previous[-2][0] in ("name", "string")
        if kind == "line":
            wrapped = wrapped or awaited
            if not commas and chain != "plus" or text[j : j + 1] == "\n":
                target = None
                commas.clear()
            if not (awaited or grouped or chain):
                previous = []
            continue
        if chain == "value" and not grouped and "\n" in text[last[3] : i] and (kind, value) != ("op", "+"):
            chain, previous, awaited = "", [], False
        if kind == "op" and value == "(" and awaited:
            grouped = wrapped = True
            continue
        if kind == "op" and value == "=" and typed and _STRING_AHEAD.match(text, j) and _TYPE.fullmatch(text, typed[1], i):
            if len(out) == typed[2] + 1:
                out.pop()
            later = later[:-1] if later and later[-1][0] == len(out) else later
            previous, wrapped, chain = [("name", typed[0], i, i), (kind, value, i, j)], False, ""
            continue
        if wrapped and not grouped and kind != "string" and "\n" in text[last[3] if previous else i : i]:
            awaited, previous, last = False, [], ("", "", 0, 0)
        wrapped = False
        # what stands in for a missing value belongs to the expression's target
        instead = target is not None and kind == "string" and (
            last[1] in ELSE if last[0] == "name" else last[1] == "||" or last[1].endswith("?") if last[0] == "other" else
            last[1] == ":" and choice or last[1] == "," and bool(commas and commas[-1]) or bool(commas) and awaited and previous[-2][1] in DEFAULTS
        )
        if instead:
            if not any(map(str.isspace, value)):
                out.append((target, Literal(text, i, j)))
                joined, named, unknown, chain = None, False, False, "value"
        elif awaited:
            inner, commas_were = previous[-2][1], bool(commas)
            typed = (inner, last[3], len(out)) if last[1] == ":" and previous[-2][0] == "name" else None
            pending: Literal | None = None
            name, whole = None, False
            if kind == "string":
                pending = None if text[max(0, i - 3) : i] in ('"' * 3, "'" * 3) and prose(value) else Literal(text, i, j)
            elif kind == "other" and last[1] == ":" and _YAML_BLOCK.match(text, i):
                start, block_end = yaml_block(text, previous[-2][2], i)
                pending = Literal(text, start, block_end)
            elif kind in ("name", "other"):
                if i >= bare_end:  # values within a bare value end where it ends
                    bare_end = _BARE.match(text, i).end()
                whole = bare_end == i + len(value)
                name = value if kind == "name" and whole else None
                if name is None or text[j : j + 1] != "(":
                    pending = known.get(name) or Literal(text, i, i if name and variable(name) else max(i, bare_end))
                else:
                    name = None
            if not commas_were:
                target, choice = inner, False
            if pending:
                if name and name not in known:
                    later.append((len(out), name))
                    holds(inner, None, name)
                else:
                    holds(inner, None if kind == "other" and whole else pending)
                out.append((inner, pending))
                joined, named, unknown, chain = None, name is not None, name is not None and name not in known, "value"
            else:
                holds(inner, None)
                chain = ""
        elif out and kind in ("string", "name") and (chain == "plus" or grouped and kind == "string" and last[0] == "string"):
            part = Literal(text, i, j) if kind == "string" else known.get(value)
            chain = "value"
            if part and part.n:
                goal, have = out[-1]
                counted(part)
                if joined is None:  # a literal of its own, as other names may stand for the first
                    joined = Literal(text, have.i, have.i if unknown else have.j)
                    joined.counts = Counter() if unknown else Counter(counted(have).counts)
                    joined.n, joined.head, joined.tail = (0, "", "") if unknown else (have.n, have.head, have.tail)
                    joined.own, joined.of = (None, [] if unknown else [have]) if named else (have.own, [*have.of])
                    if unknown and later and later[-1][0] == len(out) - 1:
                        later.pop()
                joined.add(part)
                if kind == "string":
                    joined.own = (joined.own[0] if joined.own else i, j)
                else:
                    joined.of.append(part)
                out[-1] = (goal, joined)
                holds(goal, joined)
        elif (kind, value) == ("op", "+") and chain == "value" and i >= bare_end:
            chain = "plus"
        elif i >= bare_end:
            chain = ""
        if kind == "op":
            if value == ")":
                grouped = False
                if commas:
                    commas.pop()
                else:
                    target = None
            elif value == "(" and target is not None:
                commas.append(0)
            elif value == "," and commas:
                commas[-1] += 1
            elif value in (",", ";", "{", "}"):
                target = None
                commas.clear()
        elif kind == "other" and "?" in value:
            choice = True
        if kind == "op" and value == "]" and len(previous) >= 2 and last[0] == "string" and previous[-2][1] == "[":
            previous = [last]  # table["name"] is a name
        elif kind == "name" and last[:2] == ("name", "define"):
            previous = [(kind, value, i, j), ("op", "=", j, j)]
        elif kind == "op" and value == "," and len(previous) == 3 and last[0] == "string" and previous[1][1] == "(" and previous[0][:2] == ("name", "define"):
            previous, target = [last, ("op", "=", i, j)], None
            commas.clear()
        else:
            previous = [*previous[-2:], (kind, value, i, j)]
    for k, name in later:
        seen = set()
        while name in alias and name not in seen:
            seen.add(name)
            name = alias[name]
        if name in known:
            out[k] = (out[k][0], known[name])
            for n in seen:
                holds(n, known[name])
    return out


def pair_spans(text: str, lowered: str) -> Iterator[tuple[str, int, int, float]]:
    """Literals whose target's name and look make them secrets."""
    if not ("=" in text or ":" in text or "define" in text) or not any(s in lowered for s in ("pass", "pwd", "secret", "token", "key", "cred", "auth", "signature", "salt", "cookie")):
        return
    found = [(weight, x) for target, x in pairs(text) if x.n >= SHORTEST and (weight := sensitivity(target)) and not x.placeholder()]
    first, last, counts = 0, -1, Counter()
    for _, x in sorted(found, key=lambda f: (f[1].j, -f[1].i)):  # values within one value share its end: each is counted from the next one on
        if x.random is None:
            if x.counts is None:
                if x.j != last:
                    first, last, counts = x.j, x.j, Counter()
                counts.update(text[x.i : first])
                first = x.i
            x.random = randomness(counts if x.counts is None else x.counts, x.n)
    seen, gone = set(), set()
    for weight, x in found:
        got = round(weight * x.random, 4)
        parts = [x] if got >= MIN_SCORE else []
        while parts:
            y = parts.pop()
            if id(y) not in gone:
                gone.add(id(y))
                parts += y.of
                if y.own and y.own not in seen and y.own[1] - y.own[0] >= SHORTEST_PART:
                    seen.add(y.own)
                    yield "pair", *y.own, got


def spans(text: str) -> list[tuple[str, int, int, float]]:
    found: list[tuple[str, int, int, float]] = []
    lowered = text.lower()
    if any(s in lowered for s in _STEMS):
        found += [("assign", *m.span(), 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span(), 1.0) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span(), 0.5) for m in _HEX.finditer(text)]
    found += pair_spans(text, lowered)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
_ROW = ("kind", "start", "end", "score")


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id and found, an array of (kind, start, end, score)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(_ROW, s, strict=True)) for s in spans(t.as_py())] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, _KIND)], ["doc_id", "found"])

    return common.texts_of(docs, id_col, text_col).transform(common.map_batches, scan, "doc_id long, found array<struct<kind:string,start:int,end:int,score:double>>")


def redact(text: str) -> str:
    """The text with every secret replaced by its kind; overlapping spans are replaced as one."""
    runs: list[list] = []
    for kind, i, j, _ in spans(text):
        if runs and i < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], j)
        else:
            runs.append([i, j, kind])
    out, at = [], 0
    for i, j, kind in runs:
        out += [text[at:i], f"[{kind}]"]
        at = j
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents, all kept, with their secrets replaced; n_chars, if there is one, is that of the new text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(text_col)
            old = b.column(k).to_pylist()
            new = [None if t is None else redact(t) for t in old]
            b = b.set_column(k, b.schema.field(k), pa.array(new, b.schema.field(k).type))
            if "n_chars" in b.schema.names:
                n = b.schema.get_field_index("n_chars")
                counts = [have if a is b_ or a == b_ else len(b_) for have, a, b_ in zip(b.column(n).to_pylist(), old, new, strict=True)]
                b = b.set_column(n, b.schema.field(n), pa.array(counts, b.schema.field(n).type))
            yield b

    return docs.transform(common.map_batches, scan, docs.schema)


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return digest(find_secrets(common.documents(spark, sf_dir)), KINDS[:3])
