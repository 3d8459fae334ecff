"""Secret scans: fixed patterns, and an assignment-aware lexer that scores literals by the names they reach.

The lexer reads lines that hold ``=`` or ``:`` as source or configuration
syntax: name-literal pairs with ``=``, ``:=``, ``:`` or ``=>``, quoted or bare
names and values, and sums of literals; elements that hold a literal are pairs
too. A name that says nothing of its own (``value``, ``default``) stands for
the name or key given beside it or for the name that its indented block is
under. A literal bound to a name is propagated to the names that are bound to
that name, and is scored by the most sensitive name that it reaches. The
surest names report any literal of useful length that is no placeholder; for
weaker ones its look counts too. Time is linear in the length of a text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import annotate
from .text import CHUNK_ROWS

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: In the order in which kinds at one start are listed.
KINDS = ("assign", "access", "hex", "literal")

#: How much a part of a name says that its value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0,
    "credential": 1.0, "credentials": 1.0, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "bearer": 0.9,
    "auth": 0.7, "authorization": 0.8, "private": 0.6, "access": 0.5, "api": 0.4, "key": 0.6, "pass": 0.6,
    "signing": 0.6, "salt": 0.6, "dsn": 0.6, "session": 0.5, "encryption": 0.6,
}
#: What stands where a secret would stand but is none.
PLACEHOLDER = re.compile(r"(?i)change.?me|example|placeholder|your[_-]|x{4,}|\*{3,}|<[^>]*>|\$\{|\{\{|^(?:true|false|none|null|undefined|redacted)$")
#: A name is tried from the start of its run of name characters alone, and nothing is given back: a long line is read once.
_PAIR = re.compile(r"(?P<q>[\"']?)(?<![A-Za-z0-9_$.-])[0-9.-]*+(?P<name>[A-Za-z_$][A-Za-z0-9_$.-]*+)(?P=q)[ \t]*+(?::=|=>|=(?!=)|:(?![:/]))[ \t]*+")
_TERM = re.compile(r"\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|([A-Za-z0-9_$./+=@!#%^&*~-]++)")
_PLUS = re.compile(r"[ \t]*+[+.][ \t]*+(?=[\"'A-Za-z_$])")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.-]*\Z")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*+)(?:[ \t][^<>\n]*+)?>([^<>\n]++)</")
_LEAD = re.compile(r"[ \t]*+(?:- *+)?")
#: Names that stand for another, and those that give it.
GENERIC, GIVING = frozenset({"value", "val", "default", "data", "content", "text", "string"}), frozenset({"name", "key", "id", "field"})
#: A literal is reported when the product of its name's and its own score reaches this.
LEAST = 0.45
#: A name of this score reports any literal of this length at least, whatever it looks like, that is no placeholder.
SURE, USEFUL = 0.95, 6


@lru_cache(1 << 14)
def name_score(name: str) -> float:
    parts = [x.lower() for x in _PARTS.findall(name)]
    pairs = ["".join(p) for p in zip(parts, parts[1:], strict=False)]
    miss = 1.0
    for p in {*parts, *pairs}:
        miss *= 1 - SENSITIVE.get(p, 0.0)
    return 1 - miss


def literal_score(value: str) -> float:
    """How far a literal looks like a key: its length, entropy and kinds of characters."""
    if len(value) < 8 or PLACEHOLDER.search(value) or re.search(r"\s", value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, n / 16) * min(1.0, entropy / 3.2) * (0.4 if kinds == 1 else 1.0)


def _pairs(text: str) -> Iterator[tuple[str, list[tuple[int, int, str]], list[str]]]:
    """(name, literals, names) of each pair in order: a bare word among the literals is a name as well."""
    above: list[tuple[int, str]] = []  # indents and names of the blocks that a line is within
    given, given_at = "", -1
    stop = -1
    while stop < len(text):
        start, stop = stop + 1, text.find("\n", stop + 1)
        stop = len(text) if stop < 0 else stop
        if text.find(":", start, stop) < 0 and text.find("=", start, stop) < 0 and text.find("</", start, stop) < 0:
            continue
        lead = _LEAD.match(text, start, stop).end()
        indent = lead - start
        while above and above[-1][0] >= indent:
            above.pop()
        if given_at != indent:
            given = ""
        for m in _ELEMENT.finditer(text, start, stop):
            value = m[2].strip()
            if value:
                at = m.start(2) + m[2].index(value)
                yield m[1], [(at, at + len(value), value)], []
        at = start
        while m := _PAIR.search(text, at, stop):
            name, at, literals, names = m["name"], m.end(), [], []
            while t := _TERM.match(text, at, stop):
                g = t.lastindex
                if g == 3 and _NAME.match(t[3]) and not re.search(r"\d[A-Za-z]|[a-z][A-Z0-9]\w*\d", t[3]):
                    names.append(t[3])
                    literals.append((t.start(3), t.end(3), t[3]))
                elif g:
                    literals.append((t.start(g), t.end(g), t[g]))
                at = t.end()
                plus = _PLUS.match(text, at, stop)
                if not plus:
                    break
                at = plus.end()
            if not literals:
                if at >= stop:
                    above.append((indent, name))
                continue
            low = name.lower()
            if low in GIVING:
                given, given_at = literals[0][2], indent
            elif low in GENERIC and (given or above):
                name = given or above[-1][1]
            yield name, literals, names


def lex(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that sensitive names receive, ascending.

    Names are taken from the most sensitive one down, and each constant counts
    for the first that reaches it, so no constant is walked through twice.
    """
    bound: dict[str, list[tuple[int, int, str]]] = {}
    needs: dict[str, list[str]] = {}
    uses = list(_pairs(text))
    for name, literals, names in uses:
        bound.setdefault(name, []).extend(x for x in literals if x[2] not in names)
        needs.setdefault(name, []).extend(names)
    scored = sorted(((name_score(n), i) for i, (n, _, _) in enumerate(uses)), key=lambda x: (-x[0], x[1]))
    best: dict[tuple[int, int], float] = {}
    seen: set[str] = set()
    for score, i in scored:
        if not score:
            break
        _, literals, names = uses[i]
        reach, todo = [x for x in literals if x[2] not in names or x[2] not in bound], list(names)
        while todo:  # constants that this name takes its value from
            if (n := todo.pop()) in seen:
                continue
            seen.add(n)
            reach += bound.get(n, [])
            todo += needs.get(n, [])
        value = literal_score("".join(x[2] for x in reach)) if len(reach) > 1 else 0.0
        for s, e, one in reach:
            got = score * max(literal_score(one), value if len(one) >= 4 else 0.0)
            if score >= SURE and one not in names and len(one.strip()) >= USEFUL and not PLACEHOLDER.search(one):  # a bare word is a name
                got = score
            best[s, e] = max(best.get((s, e), 0.0), got)
    return sorted(k for k, v in best.items() if v >= LEAST)


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start and then kind as listed; fixed patterns first, then literals outside of them."""
    return [(s, e, k) for s, e, k, _ in matches(text)]


def matches(text: str) -> list[tuple[int, int, str, int]]:
    """The spans with the start of the whole match of each, which for an assignment is that of its name."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(2), m.end(2), "assign", m.start()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    covered, at = sorted((x, y) for x, y, _, _ in found), 0
    far = 0  # the furthest end of the base spans before ``at``
    for s, e in lex(text):
        while at < len(covered) and covered[at][0] < e:
            far, at = max(far, covered[at][1]), at + 1
        if far <= s:
            found.append((s, e, "literal", s))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _scan(text: pa.Array) -> Iterator[dict[str, pa.Array]]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("match_start", pa.int64())]))
    for lo in range(0, len(text), CHUNK_ROWS):
        rows = text.slice(lo, CHUNK_ROWS).to_pylist()
        yield {"spans": pa.array([[{"kind": k, "start": s, "end": e, "match_start": m} for s, e, k, m in matches(t or "")] for t in rows], kind)}


def scan_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """``docs`` with the struct ``out_col``: spans (kind, start, end, match_start) in code points, end exclusive.

    A pattern's span is its secret: the value of an assignment, the whole of an
    access key or hexadecimal run. match_start is where the whole match begins,
    which for an assignment is its name; it ends where the value does. A null or empty text has none. Rows are
    judged one by one, so repeated rows and other columns change nothing.
    """
    return annotate(docs, _scan, "spans array<struct<kind:string,start:long,end:long,match_start:long>>", out_col, text_col)


def joined(spans_col: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def whole_matches(spans_col: Column) -> Column:
    """The spans from the start of their matches, by start and then kind as listed."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    placed = F.array_sort(F.transform(spans_col, lambda s: F.struct(s["match_start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(placed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def redacted(text_col: str = "text", out_col: str = "secrets", mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""
    kind = "struct<at:bigint,out:string>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(F.col(text_col), acc["at"].cast("int") + 1, F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = F.when((s["start"] >= acc["at"]), F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), fresh.alias("out")).cast(kind)

    done = F.aggregate(f"{out_col}.spans", start.cast(kind), step)
    rest = F.concat(done["out"], F.substring(F.col(text_col), done["at"].cast("int") + 1, F.length(text_col)))
    return F.when(F.size(f"{out_col}.spans") > 0, rest).otherwise(F.col(text_col))
