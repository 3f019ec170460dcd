"""Secret scan: fixed patterns plus an assignment-aware lexer with constant propagation."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed kinds, in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Lexemes of source and configuration text: strings, names, numbers, the assignment signs, the joining plus.
LEX = re.compile(
    r"""(?P<string>\"{3}(?s:.*?)\"{3}|'{3}(?s:.*?)'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*)|(?P<sign>:=|=>|==|!=|<=|>=|=|:)|(?P<plus>\+)|(?P<bare>[0-9][A-Za-z0-9+/_.\-]*)|(?P<other>[^\s])""",
    re.A,
)
#: Every sign of an assignment has one of these; else only strings in a call's arguments are paired.
HINT = re.compile(r"""[=:]|\(\s*["']|["']\s*,\s*["']""")
#: A line that ends so goes on in the next one.
OPEN = (":", "=", "=>")
QUOTES = re.compile("\"{3}|'{3}")
#: A key whose value is the indented lines that follow.
BLOCK = re.compile(r"""\s*(?:-\s+)?["']?([A-Za-z_][A-Za-z0-9_.\-]*)["']?\s*:\s*[|>][-+0-9]*\s*""", re.A)
#: A name in a text that stands for its value.
REFERENCE = re.compile(r"\$\{?([A-Za-z_][A-Za-z0-9_.\-]*)\}?", re.A)
#: Attributes whose literal names the pair, and those that hold its value.
NAMING, VALUED = {"name", "key", "id", "property"}, {"value", "val", "content", "default"}
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Weight of the words of a target's name.
NAMES = {"password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "auth": 1.5, "private": 1.5, "access": 1.0, "key": 1.5, "api": 1.0, "bearer": 2.0, "signing": 1.0, "client": 0.5, "session": 0.5}
PLAIN = {"true", "false", "null", "none", "changeme", "example", "placeholder", "undefined", "password", "secret", "token"}
LEAST_SCORE = 5.0


def name_score(name: str) -> float:
    parts = [p.lower() for p in PARTS.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:])}
    return min(4.0, sum(NAMES.get(p, 0.0) for p in dict.fromkeys([*parts, *joined])))


def literal_score(value: str) -> float:
    """Length, mixed classes and character entropy of a literal; 0 for what is plainly no secret."""
    if len(value) < 8 or value.lower() in PLAIN or re.search(r"\s|\$\{|<[^>]*>|^\{\{|\*{3}|x{4}", value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return (1.0 if n >= 12 else 0.0) + (entropy - 1.0 if entropy > 2.5 else 0.0) + 0.5 * (classes - 1)


def statements(text: str) -> Iterator[tuple[str, int]]:
    """(text, start) of each line that may assign; a line that ends with a sign together with the next line that is not
    blank, and one that opens a triple-quoted string or a block of indented lines together with the lines up to its end."""
    held: list[str] = []
    start = at = quotes = 0
    indent = None
    for line in text.split("\n"):
        end = line.rstrip()
        if indent is not None and end and len(line) - len(line.lstrip()) <= indent:
            yield "\n".join(held), start
            held, indent = [], None
        if held or HINT.search(line):
            if not held:
                start, quotes = at, 0
                if BLOCK.fullmatch(line):
                    indent = len(line) - len(line.lstrip())
            held.append(line)
            quotes += len(QUOTES.findall(line))
            if indent is None and quotes % 2 == 0 and not end.endswith(OPEN) and (end or len(held) == 1):
                yield "\n".join(held), start
                held = []
        at += len(line) + 1
    if held:
        yield "\n".join(held), start


class Constants:
    """Literals of one text and the names that stand for them: a value is a literal or another value's parts.

    Values share their parts, so sums of sums take no more room than they are written with.
    """

    def __init__(self):
        self.literals: list[tuple[str, int, int]] = []
        self.parts: list[tuple[float, list[int], list[int]]] = []  # score of the target's name, literals, values
        self.known: dict[str, int] = {}

    def literal(self, value: str, start: int, end: int) -> int:
        self.literals.append((value, start, end))
        return len(self.literals) - 1

    def assign(self, target: str, literals: list[int], values: list[int], score: float | None = None) -> None:
        """Without parts the target's value is unknown from here on."""
        if not literals and not values:
            self.known.pop(target, None)
            return
        self.parts.append((name_score(target) if score is None else score, literals, values))
        self.known[target] = len(self.parts) - 1

    def scores(self) -> list[float]:
        """Of each literal the best score of a name that reaches it; every value is passed once."""
        out, seen = [0.0] * len(self.literals), [False] * len(self.parts)
        for top in sorted(range(len(self.parts)), key=lambda i: -self.parts[i][0]):
            todo, score = [top], self.parts[top][0]
            while todo:
                i = todo.pop()
                if not seen[i]:
                    seen[i] = True
                    for x in self.parts[i][1]:
                        out[x] = max(out[x], score)
                    todo += self.parts[i][2]
        return out


def assignments(text: str) -> Constants:
    """The literals of a text with the names that they are assigned to.

    A name that is given a literal (or a sum of literals) is a constant from there on, by its name or as ${name}, until it is
    given something else. Pairs are made by assignment signs, by attributes that name and hold a value, by the strings of a
    call's arguments, by triple-quoted strings and by blocks of indented lines.
    """
    found = Constants()
    for line, start in statements(text):
        head, _, body = line.partition("\n")
        if block := BLOCK.fullmatch(head):
            own, at = [], start + len(head) + 1
            for part in body.split("\n"):
                if value := part.strip():
                    first = at + part.index(value)
                    own.append(found.literal(value, first, first + len(value)))
                at += len(part) + 1
            found.assign(block[1], own, [])
            continue
        lexemes = [(m.lastgroup, m[0], start + m.start(), start + m.end()) for m in LEX.finditer(line)]
        label = None

        def string(raw: str, a: int, b: int) -> tuple[list[int], list[int]]:
            n = 3 if len(raw) >= 6 and raw[:3] in ('"' * 3, "'" * 3) else 1
            value = raw[n:-n]
            names = [found.known[m[1]] for m in REFERENCE.finditer(value) if m[1] in found.known] if "$" in value else []
            return [found.literal(value, a + n, b - n)], names

        for i in range(1, len(lexemes) - 1):
            kind, raw, *_ = lexemes[i]
            before, after = lexemes[i - 1], lexemes[i + 1]
            # name("literal") and "name", "literal"
            if kind == "other" and after[0] == "string" and (raw == "(" and before[0] == "name" and lexemes[min(i + 2, len(lexemes) - 1)][1] == ")" or raw == "," and before[0] == "string"):
                score = name_score(before[1].strip("\"'"))
                if score:
                    found.assign(f"\n{i}", *string(*after[1:]), score)
                continue
            if kind != "sign" or raw in ("==", "!=", "<=", ">="):
                continue
            if before[0] == "other" and before[1] == "]" and i >= 2:
                before = lexemes[i - 2]
            if before[0] not in ("name", "string"):
                continue
            target = before[1].strip("\"'")
            own: list[int] = []
            values: list[int] = []
            j = i + 1
            while j < len(lexemes):
                kind, raw, a, b = lexemes[j]
                if raw == "$":  # $name and ${name}
                    j += 1 + (lexemes[min(j + 1, len(lexemes) - 1)][1] == "{")
                    if j >= len(lexemes) or lexemes[j][1] not in found.known:
                        break
                    values.append(found.known[lexemes[j][1]])
                    break
                if kind == "string":
                    x, y = string(raw, a, b)
                    own += x
                    values += y
                elif kind == "name" and raw in found.known:
                    values.append(found.known[raw])
                elif kind in ("name", "bare") and (j + 1 == len(lexemes) or lexemes[j + 1][1] in (",", ";", "}", "#")):
                    own.append(found.literal(raw, a, b))
                else:
                    break
                if j + 1 < len(lexemes) and lexemes[j + 1][0] == "plus":
                    j += 2
                else:
                    break
            if target.lower() in NAMING and own:
                label = found.literals[own[0]][0]
            scored = max(name_score(target), name_score(label)) if label and target.lower() in VALUED else None
            found.assign(target, own, values, scored)
    return found


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text, by start and then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    literal = {}
    if HINT.search(text):
        constants = assignments(text)
        for (value, a, b), score in zip(constants.literals, constants.scores(), strict=True):
            if score and score + literal_score(value) >= LEAST_SCORE and literal_score(value) > 0:
                literal[a, b] = "literal"
    found += [(a, b, k) for (a, b), k in literal.items()]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SCHEMA = "{id} {kind}, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of each whole text: counts by kind, a digest of the fixed patterns' spans, and all spans.

    Spans are kind:start:end in code points, end exclusive. One row per row of docs, repeated rows and null ids included;
    a null text counts as empty, and an empty table gives no rows. Other columns are dropped. Each text is scanned by
    itself, so there is no shuffle and a lost task is simply run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for t in batch.column(1):
                spans = scan(t.as_py() or "")
                base = ",".join(f"{k}:{a}:{b}" for a, b, k in spans if k != "literal")
                n = Counter(k for _, _, k in spans)
                for to, v in zip(rows, (*(n[k] for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, b, k in spans)), strict=True):
                    to.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            names = [id_col, "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(rows, kinds, strict=True))], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA.format(id=id_col, kind=docs.schema[id_col].dataType.simpleString()))
