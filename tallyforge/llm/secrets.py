r"""Secret scan by assignment-aware lexing.

A lexer goes through source code and configuration text and reads (name, literal) pairs. A name (plain, dotted, quoted, subscripted `x["name"]`, an array's `x[]`, with a type annotation before its sign or a type between, as `--option`) with an assignment sign opens a pair; what follows is lexed as a value:

- strings in single, double, back or triple quotes, with prefixes and escapes; several that are joined by `+`, `.` or a backslash at a line end, or that follow one another in parentheses or on a line, are one literal of several spans; a string whose end is missing ends with its line (a triple-quoted one with the text);
- calls: each string among the arguments, up to the closing parenthesis or the line's end, is a literal of its own;
- lists: each string up to the closing bracket is a literal of its own, and so is each item of the dashed lines below a name;
- several targets: `a, b = "x", "y"` at the start of a line gives each name its own value, if there are as many;
- block scalars (`name: |` and the more indented lines below it);
- XML elements (`<name>literal</name>`), and pairs of attributes or fields that hold a name and its value (`key="name" value="literal"`, in either order);
- nested mappings: a field that only carries a value (`value`, `default` and the like) has the name of the mapping that it is in, by braces or by indentation;
- unquoted words. A word, or a reference `$NAME`, `${NAME}`, that the text assigns is a name, not a literal.

Constants are propagated: a name that is assigned another name holds what the last assignment before gave to that one (or, in files whose order is free, the first one after), over any number of steps. A literal is scored by all names that come to hold it and by its own look, and one at or over the threshold is a span of kind `literal`. Names and literals may be of any length, and comments are lexed like the rest: a secret that is commented out is still one.

Beside that, three base patterns always hold (kinds assign, access, hex); their spans stay whatever the lexer says.

Defined cases: a null or empty text has no spans; texts are scanned whole; repeated rows are scanned alike, each by itself; an empty table gives an empty result; other columns pass through, except those named as a result column, which the result replaces.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

KINDS = ("assign", "access", "hex", "literal")

# The base patterns of the contract. ASCII case folding only; a match that is too short is dropped, but what it covers stays used up.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

# What makes a target name sensitive, and how much.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 2, "secret": 3, "token": 2, "apikey": 3, "credential": 3, "credentials": 3, "private": 1, "auth": 1, "access": 1, "key": 1, "signing": 1, "encryption": 1}
#: Literals that only stand for a value.
PLACEHOLDER = re.compile(r"(?i)^(?:\$\{.*\}|<.*>|x+|\*+|changeme|example|none|null|true|false|your[_-].*)$")

# Fields that carry the value of what they are in, fields that hold a name, and types that stand between a name and its sign.
CARRIERS = frozenset(("value", "val", "default", "data", "content", "string", "raw", "plain", "plaintext", "current"))
NAMERS = frozenset(("key", "name", "id", "var", "variable", "env"))
BETWEEN_TYPES = r"\*?string|\[\](?:string|byte)"

#: A name, what may stand between it and its sign, and the sign. The name is taken whole or not at all.
OPENING = re.compile(
    r"""(?<![\w.])(?:--)?["'`]?([A-Za-z_][\w.-]*+)["'`]?(?:\[\])?[\x20\t]*\]?[\x20\t]*(=>|:=|\?\?=|\|\|=|\+=|=(?!=)|:(?![:=/]))[\x20\t]*""",
    re.ASCII,
)
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>([^<>]++)</\1\s*>", re.ASCII)
STRING = re.compile(
    r"""[rRbBuUfF]{0,2}(?:\"{3}((?:[^"\\]|\\.|"(?!""))*+)(?:\"{3}|\Z)|'{3}((?:[^'\\]|\\.|'(?!''))*+)(?:'{3}|\Z)|"((?:[^"\\\n]|\\.)*+)"?|'((?:[^'\\\n]|\\.)*+)'?|`([^`\n]*+)`?)""",
    re.DOTALL,
)
JOINT = re.compile(r"[\x20\t]*(?:(?:\+|\.{1,2}|&)[\x20\t]*(?:\\?\r?\n[\x20\t]*)?|\\?\r?\n[\x20\t]*(?:\+|\.{1,2}|&)[\x20\t]*|\\\r?\n[\x20\t]*)?(?=[rRbBuUfF]{0,2}[\"'`])")
INSIDE = re.compile(r"[\s+]*(?=[rRbBuUfF]{0,2}[\"'`])")
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
TYPED = re.compile(rf"(?<![\w.])([A-Za-z_]\w*+)[\x20\t]++(?:{BETWEEN_TYPES})[\x20\t]*=(?!=)[\x20\t]*", re.ASCII)
BORROWED = re.compile(r"&(?:'\w++[\x20\t]++)?(?:mut[\x20\t]++)?[\w:<>]++[\x20\t]*=(?!=)[\x20\t]*", re.ASCII)
CAST = re.compile(r"\[\]\w++(?=\()", re.ASCII)
TARGETS = re.compile(r"^[\x20\t]*(?:(?:const|let|var|local|my)[\x20\t]++)?\(?[\x20\t]*((?:[A-Za-z_$@]\w*+[\x20\t]*,[\x20\t]*)+)$", re.ASCII)
ITEM = re.compile(r"([\x20\t]*)-[\x20\t]++(?![\x20\t])([^\n]*)")
BRACES = re.compile(rf"(?:{STRING.pattern})|[{{}}]", re.DOTALL)
#: What may stand between a field that holds a name and one that carries its value; and the other way round, where a new line begins another.
BESIDE = {True: re.compile(r"""["'`]?[\s,;]*["'`]?"""), False: re.compile(r"""["'`]?[\x20\t,;]*["'`]?""")}
ANNOTATED = re.compile(r"(?:\[[^\[\]\n]*+\])?[\x20\t]*=(?!=)[\x20\t]*")
BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[\x20\t]*\r?\n")
REFERENCE = re.compile(r"\$(?:([A-Za-z_]\w*+)|\{([A-Za-z_]\w*+)(?::?[-=?][^{}\n]*+)?\})", re.ASCII)
#: What counts inside parentheses (which end with their line) and inside brackets (which end at a brace).
INNER = {"(": re.compile(r"[()\n\"'`]"), "[": re.compile(r"[\[\]{}\"'`]")}
ENDS = {"(": ")\n", "[": "]{}"}
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
NAME = re.compile(r"[A-Za-z_]\w*\Z", re.ASCII)


def name_score(name: str) -> int:
    """How sensitive a target name is: its parts (snake, kebab or camel case, dotted; plurals too) summed."""
    parts = [p.lower() for p in WORD.findall(name)]
    joined = ["".join(parts[i : i + 2]) for i in range(len(parts) - 1)]
    return sum(SENSITIVE.get(p) or SENSITIVE.get(p.removesuffix("s"), 0) for p in parts) + 2 * ("apikey" in joined)


def literal_score(value: str) -> int:
    """How much a literal looks like a secret: length, mixed character classes, entropy a character."""
    if len(value) < 8 or PLACEHOLDER.match(value):
        return -10
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return (classes >= 2) + (classes >= 3) + (bits >= 3.0) - 2 * (" " in value)


@dataclass
class Pair:
    """A name, the spans of each literal that it is assigned, the name that it is assigned, if that is one, and where the pair and its value begin."""

    name: str
    literals: list[list[tuple[int, int]]]
    other: str | None = None
    start: int = 0
    at: int = 0


def strings_at(text: str, at: int, joint: re.Pattern) -> tuple[list[tuple[int, int]], int]:
    """The spans of the strings from `at` on that joints hold together, and where they end."""
    spans = []
    while m := STRING.match(text, at):
        spans.append(m.span(m.lastindex))
        at = m.end()
        if not (gap := joint.match(text, at)):
            break
        at = gap.end()
    return spans, at


def block_at(text: str, opening: int, at: int) -> list[tuple[int, int]]:
    """The span of the lines from `at` on that are indented deeper than the line of the opening (empty ones among them too)."""
    begin = text.rfind("\n", 0, opening) + 1
    depth = len(text[begin:opening]) - len(text[begin:opening].lstrip(" \t-"))
    first = last = None
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        indent = len(line) - len(line.lstrip(" \t"))
        if line.strip():
            if indent <= depth:
                break
            first = at + indent if first is None else first
            last = at + len(line.rstrip())
        at = end + 1
    return [] if first is None else [(first, last)]


Calls = dict[int, list[list[tuple[int, int]]]]


def named(text: str, at: int) -> bool:
    """Whether what opens at `at` (a call with its function's name) stands behind a sign of its own."""
    while at and (text[at - 1] in "_." or text[at - 1].isalnum()):
        at -= 1
    while at and text[at - 1] in " \t":
        at -= 1
    return at > 0 and text[at - 1] in "=:"


def inside_at(text: str, at: int, calls: Calls) -> list[list[tuple[int, int]]]:
    """The strings between the parenthesis or bracket at `at` and the one that closes it (or the line's end, or a brace), but for those of others inside that have a name of their own. calls keeps those inside, so that no part of a text is read for each of them."""
    if at in calls:
        return calls[at]
    kind = text[at]
    open_ = [calls.setdefault(at, [])]
    place = at + 1
    while open_ and (m := INNER[kind].search(text, place)):
        place = m.end()
        if m[0] == kind:
            open_.append(calls.setdefault(m.start(), [] if named(text, m.start()) else open_[-1]))
        elif m[0] == ENDS[kind][0]:
            open_.pop()
        elif m[0] in ENDS[kind]:
            break
        else:
            spans, place = strings_at(text, m.start(), JOINT)
            open_[-1].append(spans)
    return calls[at]


def dashes_at(text: str, opening: int, at: int) -> list[list[tuple[int, int]]]:
    """The items of the dashed lines from `at` on, no less indented than the opening's line, that are strings or words."""
    begin = text.rfind("\n", 0, opening) + 1
    depth = len(text[begin:opening]) - len(text[begin:opening].lstrip(" \t"))
    out = []
    while (m := ITEM.match(text, at)) and len(m[1]) >= depth:
        where = m.start(2)
        if STRING.match(text, where):
            out.append(strings_at(text, where, JOINT)[0])
        elif (word := BARE.match(text, where)) and not text[word.end() : m.end()].strip() and word[0][-1] != ":":
            out.append([word.span()])
        at = m.end() + 1
    return out


def targets_before(text: str, opening: int) -> list[str]:
    """The names before a name at `opening`, where they and it are the targets of one assignment that begins its line."""
    begin = text.rfind("\n", 0, opening) + 1
    if begin == opening or text[opening - 1] not in ", \t" or not (m := TARGETS.match(text[begin:opening])):
        return []
    return [x.strip(" \t$@") for x in m[1].split(",")[:-1]]


def values_at(text: str, at: int) -> list[tuple[list[list[tuple[int, int]]], str | None]]:
    """The values that stand from `at` on, with commas between them, on one line (strings may go over several)."""
    out = []
    if text.startswith("(", at):
        at += 1
    while True:
        while text[at : at + 1] in (" ", "\t"):
            at += 1
        if STRING.match(text, at):
            spans, at = strings_at(text, at, JOINT)
            out.append(([spans], None))
        elif m := BARE.match(text, at):
            out.append(([[m.span()]], m[0] if NAME.match(m[0]) else None))
            at = m.end()
        else:
            return out
        while text[at : at + 1] in (" ", "\t"):
            at += 1
        if text[at : at + 1] != ",":
            return out
        at += 1


def value_at(text: str, opening: int, sign: str, at: int, calls: Calls) -> tuple[list[list[tuple[int, int]]], str | None]:
    """The literals, or the name, that stand as a value at `at`."""
    if text.startswith("(", at):
        inner = INSIDE.match(text, at + 1)
        return ([strings_at(text, inner.end(), INSIDE)[0]] if inner else []), None
    if m := CAST.match(text, at):
        return inside_at(text, m.end(), calls), None
    if text.startswith("[", at):
        return inside_at(text, at, calls), None
    if sign == ":" and (m := BORROWED.match(text, at)):
        return value_at(text, opening, "=", m.end(), calls)
    if STRING.match(text, at):
        return [strings_at(text, at, JOINT)[0]], None
    if sign == ":" and (m := BLOCK.match(text, at)):
        return [block_at(text, opening, m.end())], None
    if m := REFERENCE.match(text, at):
        return [], m[1] or m[2]
    if sign == ":" and text.startswith("\n", at) and (items := dashes_at(text, opening, at + 1)):
        return items, None
    m = BARE.match(text, at)
    if not m:
        return [], None
    if sign == ":" and (note := ANNOTATED.match(text, m.end())):
        return value_at(text, opening, "=", note.end(), calls)
    if text.startswith("(", m.end()):
        return inside_at(text, m.end(), calls), None
    return [[m.span()]], m[0] if NAME.match(m[0]) else None


def carried(text: str, pairs: list[Pair]) -> list[str | None]:
    """For each pair whose field only carries a value, the name of the mapping that it is in: by braces, or else by indentation."""
    out: list[str | None] = [None] * len(pairs)
    wanted = [k for k, p in enumerate(pairs) if p.name.lower() in CARRIERS]
    if not wanted:
        return out
    opened = {p.at: p.name for p in pairs}
    stack: list[str | None] = []
    inside: dict[int, str | None] = {}
    todo = iter(wanted)
    k = next(todo, None)
    for m in BRACES.finditer(text) if "{" in text else ():
        while k is not None and pairs[k].at <= m.start():
            inside[k] = stack[-1] if stack else None
            k = next(todo, None)
        if m[0] == "{":
            stack.append(opened.get(m.start()) or (stack[-1] if stack and text[m.start() - 1 : m.start()] in ("[", ",") else None))
        elif m[0] == "}" and stack:
            stack.pop()
    # by indentation: of the pairs that begin their lines, the last one that is less indented and has no value of its own
    levels: list[tuple[int, str | None]] = []
    for k, p in enumerate(pairs):
        begin = text.rfind("\n", 0, p.start) + 1
        depth = p.start - begin
        if text[begin : p.start].strip(" \t-\"'"):
            continue
        while levels and levels[-1][0] >= depth:
            levels.pop()
        if p.name.lower() in CARRIERS and levels and not inside.get(k):
            inside[k] = levels[-1][1]
        levels.append((depth, None if p.literals or p.other else p.name))
    for k in wanted:
        out[k] = inside.get(k)
    return out


def lex(text: str) -> list[Pair]:
    """All pairs of a text, in order."""
    found: list[Pair] = []
    calls: Calls = {}
    for m in OPENING.finditer(text):
        before = targets_before(text, m.start()) if m[2] in ("=", ":=") else []
        values = values_at(text, m.end()) if before else []
        if before and len(values) == len(before) + 1:
            found += [Pair(n, [x for x in v if x], o, m.start(), m.end()) for n, (v, o) in zip([*before, m[1]], values)]
            continue
        literals, other = value_at(text, m.start(), m[2], m.end(), calls)
        found.append(Pair(m[1], [x for x in literals if x], other, m.start(), m.end()))
    for m in TYPED.finditer(text):
        literals, other = value_at(text, m.start(), "=", m.end(), calls)
        found.append(Pair(m[1], [x for x in literals if x], other, m.start(), m.end()))
    if "</" in text:
        for m in ELEMENT.finditer(text):
            s, e = m.span(2)
            s, e = s + len(m[2]) - len(m[2].lstrip()), e - len(m[2]) + len(m[2].rstrip())
            if s < e:
                found.append(Pair(m[1], [[(s, e)]], None, m.start(), m.start(2)))
    found.sort(key=lambda p: p.start)
    # a field that holds a name beside one that carries a value
    own = [p for p in found if len(p.literals) == 1 and len(p.literals[0]) == 1 and (p.name.lower() in NAMERS or p.name.lower() in CARRIERS)]
    more = []
    for p, q in zip(own, own[1:]):
        first, second = (x.name.lower() in NAMERS for x in (p, q))
        end = p.literals[0][0][1]
        if first != second and q.start >= end and BESIDE[first].fullmatch(text, end, q.start):
            name, value = (p, q) if first else (q, p)
            s, e = name.literals[0][0]
            more.append(Pair(text[s:e], value.literals, value.other, q.start, q.at))
    found += more + [Pair(parent, p.literals, p.other, p.start, p.at) for p, parent in zip(found, carried(text, found)) if parent]
    return sorted((p for p in found if p.literals or p.other), key=lambda p: p.start)


def lexed_spans(text: str, threshold: int = 4) -> list[tuple[int, int]]:
    """Spans of literals whose target names and look together reach the threshold, with constants propagated."""
    pairs = lex(text)
    first: dict[str, int] = {}
    for k, p in enumerate(pairs):
        first.setdefault(p.name, k)
    # what each pair's name holds: its own literals, or what the pair holds that assigned the other name last (or first, after it)
    last: dict[str, int] = {}
    source: list[int | None] = []
    for k, p in enumerate(pairs):
        known = p.other is not None and p.other != p.name and p.other in first
        source.append(last.get(p.other, first[p.other]) if known else None)
        last[p.name] = k
    best = [0] * len(pairs)
    for k, p in enumerate(pairs):
        score, at, seen = name_score(p.name), k, set()
        while at is not None and at not in seen:
            seen.add(at)
            if best[at] >= score and at != k:
                break  # what lies behind has this score already
            best[at] = max(best[at], score)
            at = source[at]
    spans = set()
    for p, score, origin in zip(pairs, best, source):
        if score >= 2 and origin is None:
            for parts in p.literals:
                if score + literal_score("".join(text[s:e] for s, e in parts)) >= threshold:
                    spans.update(x for x in parts if x[0] < x[1])
    return sorted(spans)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base patterns, by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str, threshold: int = 4) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans: those and the lexer's."""
    base = base_spans(text)
    if "=" not in text and ":" not in text and "</" not in text:  # one of these is in every pair
        return base, base
    return base, sorted(base + [(s, 3, e) for s, e in lexed_spans(text, threshold)])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, text: str = "text", threshold: int = 4, keep: list[str] | None = None) -> DataFrame:
    """docs with base_spans and secret_spans (arrays of struct kind, start, end; code points, end exclusive)."""

    def batch(texts: list[str]) -> dict[str, pa.Array]:
        found = [scan(t, threshold) for t in texts]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        rows = [[[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x[i]] for x in found] for i in (0, 1)]
        return {"base_spans": pa.array(rows[0], kind), "secret_spans": pa.array(rows[1], kind)}

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_texts(docs, batch, f"base_spans {span}, secret_spans {span}", text, keep)


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """text with each span (overlapping ones merged) replaced by mark."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sha256_hex(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
