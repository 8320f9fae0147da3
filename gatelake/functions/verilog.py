"""Reading Verilog text: preprocessing, syntax of a module and what it connects. Plain Python that the scan tables share.

Texts are read as tokens; a module's body becomes a list of statements, and ``Scope`` interprets them under a parameter
context (generate loops unrolled, conditions folded). Nothing here knows about files or Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import product

# ---------------------------------------------------------------- comments and conditional compilation

_ENGINE_1 = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_ENGINE_2 = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)

#: Values with which a defined macro still counts as not defined.
INACTIVE = ("", "0", "false", "1'b0", "'b0", "1'h0", "'h0")
#: Marker that stands for the text of an ignored file.
IGNORED_STUB = "/* ignored path */"


def strip_comments(text: str) -> str:
    """Without comments; not aware of strings, and a block comment takes its line ends with it."""
    return _ENGINE_1.sub("", text)


def blank_comments(text: str) -> str:
    """Without comments, aware of strings; a block comment becomes blanks and keeps its line ends."""

    def put(m: re.Match) -> str:
        s = m[0]
        if s[0] == '"':
            return s
        return "" if s.startswith("//") else re.sub(r"[^\n]", " ", s)

    return _ENGINE_2.sub(put, text)


def is_active(name: str, defines: dict[str, str]) -> bool:
    return name in defines and str(defines[name]).strip().lower() not in INACTIVE


_DIRECTIVE = re.compile(r"`(ifdef|ifndef|elsif|else|endif|define|undef|include|timescale|default_nettype|resetall|celldefine|endcelldefine)\b[ \t]*", re.I)
_NAME = re.compile(r"[A-Za-z_]\w*")


@dataclass
class Preprocessed:
    text: str
    defines: dict[str, str]
    ops: list[tuple[str, str, str]] = field(default_factory=list)
    includes: list[tuple[str, str]] = field(default_factory=list)


def preprocess(text: str, defines: dict[str, str] | None = None, include: Callable[[str, str], str | None] | None = None, depth: int = 0, preserve: bool = False) -> Preprocessed:
    """Text of the active branches with object-like macros expanded; directives may stand inside a line.

    ``include`` gives the text for a quote character and name; what it doesn't know is left out. A macro whose value
    starts with a parenthesis is left as it is written. Line ends outside removed includes stay. With ``preserve`` the text
    of all branches stays, and only the directives go.
    """
    out, done = [], Preprocessed("", dict(defines or {}))
    stack: list[list[bool]] = []  # parent active, active, branch taken
    clean, at = strip_comments(text), 0
    active = True
    while at < len(clean):
        m = _DIRECTIVE.search(clean, at)
        piece = clean[at : m.start() if m else len(clean)]
        out.append(expand_macros(piece, done.defines) if active else "\n" * piece.count("\n"))
        if not m:
            break
        at, word = m.end(), m[1].lower()
        if word in ("ifdef", "ifndef", "elsif"):
            name = _NAME.match(clean, at)
            at = name.end() if name else at
            hit = is_active(name[0], done.defines) if name else False
            if word == "elsif":
                if stack:
                    parent, _, taken = stack[-1]
                    stack[-1] = [parent, parent and hit and not taken, taken or hit]
            else:
                hit = hit if word == "ifdef" else not hit
                stack.append([active, active and hit, hit])
        elif word == "else":
            if stack:
                parent, _, taken = stack[-1]
                stack[-1] = [parent, parent and not taken, True]
        elif word == "endif":
            if stack:
                stack.pop()
        else:
            end = clean.find("\n", at)
            end = len(clean) if end < 0 else end
            line = clean[at:end]
            if word == "define":
                while line.rstrip().endswith("\\") and end < len(clean):
                    nxt = clean.find("\n", end + 1)
                    nxt = len(clean) if nxt < 0 else nxt
                    line, end = line.rstrip()[:-1] + " " + clean[end + 1 : nxt], nxt
            at = end
            if active and word == "define" and (name := _NAME.match(line)):
                rest = line[name.end() :]
                done.defines[name[0]] = rest.strip() or ("1" if not rest.startswith("(") else "")
                done.ops.append(("set", name[0], done.defines[name[0]]))
            elif active and word == "undef" and (name := _NAME.match(line)):
                done.defines.pop(name[0], None)
                done.ops.append(("undef", name[0], ""))
            elif active and word == "include" and (inc := re.match(r"([\"<])([^\">]+)[\">]", line)):
                done.includes.append((inc[1], inc[2]))
                body = include(inc[1], inc[2]) if include and depth < 200 else None
                if body is not None:
                    inner = preprocess(body, done.defines, include, depth + 1, preserve)
                    done.defines, done.ops, done.includes = inner.defines, done.ops + inner.ops, done.includes + inner.includes
                    out.append(inner.text)
        active = preserve or all(x[1] for x in stack)
    done.text = "".join(out)
    return done


def expand_macros(text: str, defines: dict[str, str]) -> str:
    """Object-like macros replaced, macros in their values too; unknown ones and values in parentheses stay."""

    def put(m: re.Match) -> str:
        value = defines.get(m[1])
        return m[0] if value is None or value.startswith("(") else value

    for _ in range(8):
        new = re.sub(r"`([A-Za-z_]\w*)", put, text) if "`" in text else text
        if new == text:
            break
        text = new
    return text


# ---------------------------------------------------------------- tokens, modules and statements

_TOKEN = re.compile(
    r"(?P<ws>\s+)|\\\S+|(?:\d+\s*)?'[sS]?[bBoOdDhH]\s*[0-9a-fA-FxXzZ?_]+|\d[\d_]*(?:\.\d+)?|[A-Za-z_$][\w$]*|`\w+|\"(?:\\.|[^\"\\])*\"|<<<|>>>|===|!==|<=|>=|==|!=|&&|\|\||<<|>>|\*\*|->|::|\+:|-:|."
)
_MODULE = re.compile(r"^[ \t]*(module|interface|program)\s+(?:automatic\s+|static\s+)?([A-Za-z_][\w$]*)", re.M)
_BLOCK = re.compile(r"(?<![\w$`.])(module|interface|program)\s+(?:automatic\s+|static\s+)?([A-Za-z_][\w$]*)(?=\s*[#(;]|\s+import\b)")
_ENDS = {"module": re.compile(r"\bendmodule\b"), "interface": re.compile(r"\bendinterface\b"), "program": re.compile(r"\bendprogram\b")}
NET_WORDS = frozenset("wire reg logic tri tri0 tri1 wand wor supply0 supply1 integer genvar bit byte int shortint longint real time var uwire".split())
PORT_WORDS = frozenset(("input", "output", "inout", "ref"))
GATES = frozenset("and nand or nor xor xnor buf not bufif0 bufif1 notif0 notif1 tran pullup pulldown".split())
_NOT_CELLS = NET_WORDS | PORT_WORDS | GATES | frozenset(
    "assign always always_ff always_comb always_latch initial final begin end if else for case casez casex endcase generate endgenerate function endfunction task endtask typedef import export modport clocking property sequence assert assume cover parameter localparam defparam bind return while repeat forever force release deassign specify endspecify signed unsigned struct enum union packed default package endpackage class endclass".split()
)


@dataclass(frozen=True)
class Tok:
    text: str
    line: int


def tokens(text: str, line: int = 1) -> list[Tok]:
    out = []
    for m in _TOKEN.finditer(text):
        s = m[0]
        if m["ws"] is None:
            out.append(Tok(s, line))
        line += s.count("\n")
    return out


@dataclass(frozen=True)
class Module:
    name: str
    kind: str
    text: str
    line: int


def modules(text: str) -> list[Module]:
    """Modules, interfaces and programs of preprocessed text; one that never ends runs to the next or the end."""
    out, at = [], 0
    while m := _BLOCK.search(text, at):
        end = _ENDS[m[1]].search(text, m.end())
        nxt = _BLOCK.search(text, m.end())
        stop = end.end() if end and not (nxt and nxt.start() < end.start() and m[1] != "interface") else nxt.start() if nxt else len(text)
        body = text[m.start() : end.start() if end and end.start() < stop else stop]
        out.append(Module(m[2], m[1], body, text.count("\n", 0, m.start()) + 1))
        at = max(stop, m.end())
    return out


def declared_names(text: str) -> list[str]:
    """Names after module, interface or program at the start of a line, without any preprocessing."""
    return [m[2] for m in _MODULE.finditer(text)]


def _match(ts: list[Tok], i: int) -> int:
    """Index after the bracket that closes the one at ``i``."""
    pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
    a = ts[i].text
    b = pairs[a]
    while i < len(ts):
        depth += (ts[i].text == a) - (ts[i].text == b)
        i += 1
        if not depth:
            break
    return i


def split_top(ts: list[Tok], sep: str = ",") -> list[list[Tok]]:
    out, depth = [[]], 0
    for t in ts:
        depth += (t.text in "([{") - (t.text in ")]}") if len(t.text) == 1 else 0
        if t.text == sep and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return out if out != [[]] else []


def text_of(ts: Iterable[Tok]) -> str:
    """Tokens as compact text: a blank only where two words would run together."""
    s = ""
    for t in ts:
        s += (" " if s and (s[-1].isalnum() or s[-1] in "_$") and (t.text[0].isalnum() or t.text[0] in "_$\\") else "") + t.text
    return s


class Parser:
    """Statements of a token list: ('simple', toks), ('block', label, stmts), ('if', cond, a, b), ('for', head, stmt),
    ('case', word, selector, [(labels or None, stmt)]), ('always', word, sensitivity, stmt)."""

    def __init__(self, ts: list[Tok]):
        self.ts, self.i = ts, 0

    def peek(self, k: int = 0) -> str:
        return self.ts[self.i + k].text if self.i + k < len(self.ts) else ""

    def all(self) -> list[tuple]:
        out = []
        while self.i < len(self.ts):
            before = self.i
            if (s := self.statement()) is not None:
                out.append(s)
            if self.i == before:
                self.i += 1
        return out

    def _paren(self) -> list[Tok]:
        if self.peek() != "(":
            return []
        a, self.i = self.i, _match(self.ts, self.i)
        return self.ts[a + 1 : self.i - 1]

    def _label(self) -> str:
        if self.peek() == ":" and self.i + 1 < len(self.ts):
            self.i += 2
            return self.ts[self.i - 1].text
        return ""

    def statement(self) -> tuple | None:
        word, a = self.peek(), self.i
        if not word:
            return None
        if word in ("generate", "endgenerate", ";"):
            self.i += 1
            return None
        if word == "begin":
            self.i += 1
            label, inner = self._label(), []
            while self.i < len(self.ts) and self.peek() != "end":
                before = self.i
                if (s := self.statement()) is not None:
                    inner.append(s)
                if self.i == before:
                    self.i += 1
            self.i += 1
            self._label()
            return ("block", label, inner)
        if word in ("unique", "priority", "unique0") and self.peek(1) in ("if", "case", "casez", "casex"):
            self.i += 1
            return self.statement()
        if word == "if":
            self.i += 1
            cond, then = self._paren(), self.statement()
            other = None
            if self.peek() == "else":
                self.i += 1
                other = self.statement()
            return ("if", cond, then, other)
        if word == "for":
            self.i += 1
            return ("for", self._paren(), self.statement())
        if word in ("case", "casez", "casex"):
            self.i += 1
            selector, arms = self._paren(), []
            while self.i < len(self.ts) and self.peek() != "endcase":
                b = self.i
                if self.peek() == "default":
                    self.i += 1
                    if self.peek() == ":":
                        self.i += 1
                    labels = None
                else:
                    depth = 0
                    while self.i < len(self.ts) and (self.peek() != ":" or depth):
                        depth += (self.peek() in ("(", "[", "{")) - (self.peek() in (")", "]", "}"))
                        self.i += 1
                    labels = split_top(self.ts[b : self.i])
                    self.i += 1
                arms.append((labels, self.statement()))
                if self.i == b:
                    self.i += 1
            self.i += 1
            return ("case", word, selector, arms)
        if word in ("always", "always_ff", "always_comb", "always_latch", "initial", "final"):
            self.i += 1
            sens: list[Tok] = []
            if self.peek() == "@":
                self.i += 1
                sens = self._paren() if self.peek() == "(" else [self.ts[self.i]] if self.i < len(self.ts) else []
                if not sens or sens[0].text == "*" and self.ts[self.i - 1].text != ")":
                    self.i += 1
            return ("always", word, sens, self.statement())
        for opener, closer in (("function", "endfunction"), ("task", "endtask"), ("specify", "endspecify"), ("property", "endproperty"), ("clocking", "endclocking"), ("class", "endclass")):
            if word == opener:
                while self.i < len(self.ts) and self.peek() != closer:
                    self.i += 1
                self.i += 1
                return None
        depth = 0
        while self.i < len(self.ts):
            t = self.peek()
            if t == ";" and not depth:
                break
            depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
            self.i += 1
        self.i += 1
        return ("simple", self.ts[a : self.i - 1])


# ---------------------------------------------------------------- constants and parameters

_PRECEDENCE = (("==", "!=", "===", "!==", "<", "<=", ">", ">="), ("+", "-"), ("*",))


def literal(s: str) -> int | None:
    s = s.replace("_", "").replace(" ", "")
    if s.isdigit():
        return int(s)
    if m := re.fullmatch(r"\d*'[sS]?([bBoOdDhH])([0-9a-fA-F]+)", s):
        try:
            return int(m[2], {"b": 2, "o": 8, "d": 10, "h": 16}[m[1].lower()])
        except ValueError:
            return None
    return None


def evaluate(ts: list[Tok] | str, ctx: dict[str, str], seen: frozenset = frozenset()) -> int | None:
    """Value of a constant expression: numbers, names, + - *, comparisons, !, unary signs, ternary and parentheses.

    Every other operator (division, modulus, shifts, logic) makes it unknown.
    """
    if isinstance(ts, str):
        if ts.isascii() and ts.isdigit():
            return int(ts)
        ts = tokens(ts)
    at = 0

    def peek() -> str:
        return ts[at].text if at < len(ts) else ""

    def primary() -> int | None:
        nonlocal at
        t = peek()
        at += 1
        if t == "(":
            v = ternary()
            if peek() != ")":
                raise ValueError
            at += 1
            return v
        if t in ("-", "+"):
            v = primary()
            return None if v is None else -v if t == "-" else v
        if t == "!":
            v = primary()
            return None if v is None else int(not v)
        if (v := literal(t)) is not None:
            return v
        if _NAME.fullmatch(t) and peek() not in ("(", "[", "."):
            if t in seen or t not in ctx:
                return None
            return evaluate(str(ctx[t]), ctx, seen | {t})
        raise ValueError

    def level(k: int) -> int | None:
        nonlocal at
        if k == len(_PRECEDENCE):
            return primary()
        v = level(k + 1)
        while peek() in _PRECEDENCE[k]:
            op = peek()
            at += 1
            w = level(k + 1)
            if v is None or w is None:
                v = None
            else:
                v = {"+": v + w, "-": v - w, "*": v * w, "==": int(v == w), "===": int(v == w), "!=": int(v != w), "!==": int(v != w), "<": int(v < w), "<=": int(v <= w), ">": int(v > w), ">=": int(v >= w)}[op]
        return v

    def ternary() -> int | None:
        nonlocal at
        v = level(0)
        if peek() == "?":
            at += 1
            a = ternary()
            if peek() != ":":
                raise ValueError
            at += 1
            b = ternary()
            return None if v is None else a if v else b
        return v

    try:
        v = ternary()
    except (ValueError, RecursionError):
        return None
    return v if at >= len(ts) and ts else None


def resolve_parameters(declared: list[tuple[str, str]], overrides: dict[str, str] | None = None, parent: dict[str, str] | None = None) -> dict[str, str]:
    """Values of declared parameters: overrides, seen in the parent's context, beat declarations; unknown ones keep their text."""
    outer = dict(parent or {})
    out = {}
    for name, value in (overrides or {}).items():
        v = evaluate(value, outer)
        out[name] = str(v) if v is not None else value
    for name, value in declared:
        out.setdefault(name, value)
    names = {n for n, _ in declared} | set(overrides or {})
    for _ in range(len(declared) + 2):
        changed = False
        for name in list(out):
            v = evaluate(out[name], {k: x for k, x in out.items() if k != name})
            if v is not None and out[name] != str(v):
                out[name], changed = str(v), True
        if not changed:
            break
    return {n: out[n] for n in out if n in names}


# ---------------------------------------------------------------- modules under a context

MAX_UNROLL = 64
MAX_ARRAY = 64
MAX_PORT_BITS = 512


def span(dims: list[list[Tok]], ctx: dict[str, str], cap: int) -> list[str] | None:
    """Index suffixes of dimensions, outermost first, each counted upward; None if one is unknown or wider than ``cap``."""
    per = []
    for d in dims:
        parts = split_top(d, ":")
        lo, hi = (evaluate(parts[-1], ctx), evaluate(parts[0], ctx)) if len(parts) == 2 else (0, None if (n := evaluate(d, ctx)) is None else n - 1)
        if lo is None or hi is None or abs(hi - lo) + 1 > cap:
            return None
        per.append([f"[{i}]" for i in range(min(lo, hi), max(lo, hi) + 1)])
    return ["".join(p) for p in product(*per)]


@dataclass
class Instance:
    name: str
    cell: str
    overrides: dict[str, str]
    ports: list[tuple[str, str]]
    line: int


@dataclass
class Port:
    name: str
    direction: str
    dims: str
    line: int
    names: list[str]


@dataclass
class Edge:
    """A connection inside a module: ``src`` drives ``dst``."""

    src: str
    dst: str
    kind: str
    line: int


@dataclass
class Contents:
    parameters: list[tuple[str, str]] = field(default_factory=list)
    ports: list[Port] = field(default_factory=list)
    nets: list[tuple[str, str]] = field(default_factory=list)
    instances: list[Instance] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)
    binds: list[tuple[str, Instance]] = field(default_factory=list)
    constants: set[str] = field(default_factory=set)


class Scope:
    """One module's text interpreted under parameter values."""

    def __init__(self, module: Module, overrides: dict[str, str] | None = None, parent: dict[str, str] | None = None, over_approximate: bool = True, fold_constants: bool = True):
        self.module, self.over, self.fold = module, over_approximate, fold_constants
        self.out = Contents()
        self._read: dict[int, tuple[list[Tok], list[tuple[str, str]], list[Instance]]] = {}
        ts = tokens(module.text, module.line)
        header, body = self._split(ts)
        self._header(header)
        statements = Parser(body).all()
        for s in statements:
            if s[0] == "simple" and s[1] and s[1][0].text in ("parameter", "localparam"):
                self._parameters(s[1])
        self.ctx = resolve_parameters(self.out.parameters, overrides, parent)
        self._ports_resolved(header)
        self._walk(statements, dict(self.ctx), "")
        driven = self.out.constants
        if driven and fold_constants:
            self.out.edges = [e for e in self.out.edges if e.src not in driven and e.dst not in driven]

    @staticmethod
    def _split(ts: list[Tok]) -> tuple[list[Tok], list[Tok]]:
        i = 0
        while i < len(ts) and ts[i].text != ";":
            i = _match(ts, i) if ts[i].text in ("(", "[", "{") else i + 1
        return ts[:i], ts[i + 1 :]

    def _header(self, ts: list[Tok]) -> None:
        for k, t in enumerate(ts):
            if t.text == "#" and k + 1 < len(ts) and ts[k + 1].text == "(":
                self._parameters([Tok("parameter", t.line), *ts[k + 2 : _match(ts, k + 1) - 1]])
                break

    def _parameters(self, ts: list[Tok]) -> None:
        for part in split_top(ts[1:]):
            names = [x for x in part]
            if any(t.text == "=" for t in names):
                k = next(i for i, t in enumerate(names) if t.text == "=")
                j = k - 1
                while j > 0 and names[j].text == "]":
                    while j > 0 and names[j].text != "[":
                        j -= 1
                    j -= 1
                if names[j].text not in ("parameter", "localparam"):
                    self.out.parameters.append((names[j].text, text_of(names[k + 1 :])))

    def _ports_resolved(self, header: list[Tok]) -> None:
        k = 0
        while k < len(header) and header[k].text not in ("(", "#"):
            k += 1
        if k < len(header) and header[k].text == "#":
            k = _match(header, k + 1)
        if k >= len(header):
            return
        direction, dims, self.listed = "", [], []
        for part in split_top(header[k + 1 : _match(header, k) - 1]):
            if not part:
                continue
            words = [t for t in part]
            if words[0].text in PORT_WORDS:
                direction, dims = words[0].text, []
            elif len(words) > 1 and words[0].text not in (".",):
                direction, dims = direction or "inout", []
            name, before, after = self._declarator(words)
            if before:
                dims = before
            if name is None:
                continue
            if direction:
                self._port(name, direction, dims + after)
            else:
                self.listed.append(name.text)

    @staticmethod
    def _declarator(ts: list[Tok]) -> tuple[Tok | None, list[list[Tok]], list[list[Tok]]]:
        """Name of one declared item with the dimensions before and after it."""
        before, after, name, i = [], [], None, 0
        while i < len(ts):
            t = ts[i].text
            if t == "=":
                break
            if t == "[":
                end = _match(ts, i)
                (after if name is not None and name.text not in NET_WORDS else before).append(ts[i + 1 : end - 1])
                i = end
                continue
            if (_NAME.fullmatch(t) or t.startswith("\\")) and t not in PORT_WORDS and t not in NET_WORDS and t not in ("signed", "unsigned"):
                if name is not None:  # a type name came first
                    before, after = before + after, []
                name = ts[i]
            i += 1
        return name, before, after

    def _port(self, name: Tok, direction: str, dims: list[list[Tok]]) -> None:
        if any(p.name == name.text for p in self.out.ports):
            return
        shown = "".join(f"[{text_of(d)}]" for d in dims)
        got = span(dims, self.ctx, MAX_PORT_BITS) if dims else []
        names = [name.text] if not dims else [name.text + x for x in got or []] + [name.text + self._resolved(dims), name.text] if got is not None else [name.text + shown, name.text]
        self.out.ports.append(Port(name.text, direction, shown, name.line, list(dict.fromkeys(names))))

    def _resolved(self, dims: list[list[Tok]]) -> str:
        out = ""
        for d in dims:
            out += "[" + ":".join(str(v) if (v := evaluate(p, self.ctx)) is not None else text_of(p) for p in split_top(d, ":")) + "]"
        return out

    # -- statements

    def _walk(self, statements: list[tuple], ctx: dict[str, str], prefix: str) -> None:
        for s in statements:
            self._statement(s, ctx, prefix)

    def _statement(self, s: tuple | None, ctx: dict[str, str], prefix: str) -> None:
        if s is None:
            return
        kind = s[0]
        if kind == "block":
            self._walk(s[2], ctx, prefix + (f"{s[1]}." if s[1] else ""))
        elif kind == "if":
            v = evaluate(s[1], ctx)
            if v is not None:
                self._statement(s[2] if v else s[3], ctx, prefix)
            elif self.over:
                self._statement(s[3], ctx, prefix)
        elif kind == "for":
            self._unroll(s, ctx, prefix)
        elif kind == "case":
            v = evaluate(s[2], ctx)
            if v is not None:
                for labels, arm in s[3]:
                    if labels is None or any(evaluate(x, ctx) == v for x in labels):
                        self._statement(arm, ctx, prefix)
                        break
        elif kind == "always":
            if s[1] in ("initial", "final"):
                return
            if s[1] == "always_ff" or any(t.text in ("posedge", "negedge") for t in s[2]):
                for src, dst, line in self._registers(s[3], ctx, True):
                    self._edge(src, dst, "ff", line)
            else:
                last: dict[str, tuple[list[str], int]] = {}
                self._combinational(s[3], ctx, last)
                for dst, (sources, line) in last.items():
                    for src in sources:
                        self._edge(src, dst, "comb", line)
        elif s[1]:
            self._simple(s[1], ctx, prefix)

    def _unroll(self, s: tuple, ctx: dict[str, str], prefix: str) -> None:
        parts = split_top(s[1], ";")
        if len(parts) != 3:
            return
        init, cond, step = parts
        init = [t for t in init if t.text not in ("genvar", "int", "integer")]
        if len(init) < 3 or len(cond) < 3:
            return
        var = init[0].text
        lo = evaluate(init[2:], ctx) or 0
        op = next((i for i, t in enumerate(cond) if t.text == "<"), None)
        if op is None:
            return
        hi = evaluate(cond[op + 1 :], ctx)
        if hi is None or hi - lo > MAX_UNROLL:
            return
        body = s[2]
        label = body[1] if body and body[0] == "block" else ""
        inner = body[2] if body and body[0] == "block" else [body]
        step_by = 1
        if len(step) >= 5 and step[-1].text.isdigit():
            step_by = max(1, int(step[-1].text))
        for i in range(lo, hi, step_by):
            self._walk(inner, ctx | {var: str(i)}, f"{prefix}{label}[{i}]." if label else prefix)

    def _simple(self, ts: list[Tok], ctx: dict[str, str], prefix: str) -> None:
        word = ts[0].text
        if word in ("parameter", "localparam"):
            return
        if word in PORT_WORDS or word in NET_WORDS:
            self._declare(ts, ctx)
        elif word == "assign":
            for part in split_top(ts[1:]):
                self._assign(part, ctx, "assign")
        elif word in GATES:
            self._gate(ts, ctx)
        elif word == "bind":
            if len(ts) > 3:
                for inst in self._instances(ts[2:], ctx, ""):
                    self.out.binds.append((ts[1].text, inst))
        elif (_NAME.fullmatch(word) or word.startswith("\\")) and word not in _NOT_CELLS:
            self.out.instances.extend(self._instances(ts, ctx, prefix))

    def _declare(self, ts: list[Tok], ctx: dict[str, str]) -> None:
        direction = ts[0].text if ts[0].text in PORT_WORDS else ""
        dims: list[list[Tok]] = []
        for k, part in enumerate(split_top(ts)):
            name, before, after = self._declarator(part)
            dims = before if k == 0 else dims
            if name is None:
                continue
            if direction:
                self._port(name, direction, dims + after)
            self.out.nets.append((name.text, self._resolved(dims + after)))
            if ts[0].text in ("supply0", "supply1"):
                self.out.constants.add(name.text)
            eq = next((i for i, t in enumerate(part) if t.text == "="), None)
            if eq is not None and ts[0].text not in ("genvar", "integer"):
                self._assign([name, *part[eq:]], ctx, "assign")

    def _instances(self, ts: list[Tok], ctx: dict[str, str], prefix: str) -> list[Instance]:
        """Instances of a statement. In a loop it is read once for all rounds that give its names the same numbers."""
        values = [(t.text, ctx[t.text]) for t in ts if t.text in ctx]
        if not all(v.isascii() and v.isdigit() for _, v in values):
            return self._instances_read(ts, ctx, prefix)
        known = self._read.get(id(ts))
        if known is None or known[1] != values:
            known = self._read[id(ts)] = ts, values, self._instances_read(ts, ctx, "")
        return [Instance(prefix + i.name, i.cell, dict(i.overrides), list(i.ports), i.line) for i in known[2]]

    def _instances_read(self, ts: list[Tok], ctx: dict[str, str], prefix: str) -> list[Instance]:
        cell, i, overrides, out = ts[0].text, 1, {}, []
        if i < len(ts) and ts[i].text == "#":
            if i + 1 < len(ts) and ts[i + 1].text == "(":
                end = _match(ts, i + 1)
                for part in split_top(ts[i + 2 : end - 1]):
                    if len(part) > 3 and part[0].text == "." and part[2].text == "(":
                        overrides[part[1].text] = self._known(part[3:-1], ctx)
                i = end
            else:
                i += 2
        for part in split_top(ts[i:]):
            if not part or not (_NAME.fullmatch(part[0].text) or part[0].text.startswith("\\")):
                continue
            k, dims = 1, []
            while k < len(part) and part[k].text == "[":
                end = _match(part, k)
                dims.append(part[k + 1 : end - 1])
                k = end
            if k >= len(part) or part[k].text != "(":
                continue
            maps = []
            for conn in split_top(part[k + 1 : _match(part, k) - 1]):
                if len(conn) >= 2 and conn[0].text == ".":
                    maps.append((conn[1].text, self._known_nets(conn[3:-1], ctx) if len(conn) > 3 else conn[1].text if len(conn) == 2 else ""))
            names = span(dims, ctx, MAX_ARRAY) if dims else [""]
            names = [f"[{text_of(dims[0])}]"] if names is None else names
            for suffix in names:
                own = [(p, e + suffix if suffix and re.fullmatch(r"[A-Za-z_]\w*", e) and e not in ("clk", "rst_n", "probe_in") else e) for p, e in maps]
                out.append(Instance(f"{prefix}{part[0].text}{suffix}", cell, dict(overrides), own, part[0].line))
        return out

    def _known(self, ts: list[Tok], ctx: dict[str, str]) -> str:
        v = evaluate(ts, ctx)
        return str(v) if v is not None else text_of(ts)

    def _known_nets(self, ts: list[Tok], ctx: dict[str, str]) -> str:
        """An expression with its selects' constant indices put in."""
        out, i = [], 0
        while i < len(ts):
            if ts[i].text == "[" and i:
                end = _match(ts, i)
                out.append(Tok("[" + ":".join(self._known(p, ctx) for p in split_top(ts[i + 1 : end - 1], ":")) + "]", ts[i].line))
                i = end
            else:
                out.append(ts[i])
                i += 1
        return text_of(out)

    # -- nets in expressions

    def roots(self, ts: list[Tok], ctx: dict[str, str]) -> list[str]:
        """Signals of an expression with their constant selects; names of parameters and calls are left out."""
        out, i = [], 0
        while i < len(ts):
            t = ts[i].text
            if not (_NAME.fullmatch(t) or t.startswith("\\")) or t in _NOT_CELLS:
                i += 1
                continue
            if i + 1 < len(ts) and ts[i + 1].text == "(":
                i = _match(ts, i + 1)
                continue
            name, i = t, i + 1
            while i + 1 < len(ts) and ts[i].text == "." and _NAME.fullmatch(ts[i + 1].text):
                name += "." + ts[i + 1].text
                i += 2
            select = ""
            while i < len(ts) and ts[i].text == "[":
                end = _match(ts, i)
                parts = [evaluate(p, ctx) for p in split_top(ts[i + 1 : end - 1], ":")]
                select += "[" + ":".join(map(str, parts)) + "]" if all(p is not None for p in parts) else "[?]"
                i = end
            if name not in ctx:
                out.append(name if "?" in select else name + select)
        return list(dict.fromkeys(out))

    def _constant(self, ts: list[Tok], ctx: dict[str, str]) -> bool:
        while len(ts) > 1 and ts[0].text == "(" and _match(ts, 0) == len(ts):
            ts = ts[1:-1]
        return len(ts) == 1 and bool(literal(ts[0].text) is not None or re.fullmatch(r"\d*'[sS]?[bodhBODH].*", ts[0].text)) or evaluate(ts, ctx) is not None

    def effective(self, ts: list[Tok], ctx: dict[str, str]) -> list[str]:
        """Signals of a right side that its value may depend on.

        Folded: constants, calls, a+0, a-a, a^a, a&a, a*1, x*0, x&0, a&~a, a|~a, a ternary on a constant; of one on an
        unknown condition both arms count, or the false arm where nothing is assumed.
        """
        if not self.fold:
            return self.roots(ts, ctx)
        while len(ts) > 1 and ts[0].text == "(" and _match(ts, 0) == len(ts):
            ts = ts[1:-1]
        if not ts or self._constant(ts, ctx):
            return []
        if len(ts) > 1 and ts[1].text == "(" and _NAME.fullmatch(ts[0].text) and _match(ts, 1) == len(ts):
            return []
        question = split_top(ts, "?")
        if len(question) == 2:
            arms = split_top(question[1], ":")
            if len(arms) == 2:
                v = evaluate(question[0], ctx)
                if v is not None:
                    return self.effective(arms[0] if v else arms[1], ctx)
                sides = (question[0], arms[0], arms[1]) if self.over else (arms[1],)
                return list(dict.fromkeys(x for p in sides for x in self.effective(p, ctx)))
        for op in ("|", "^", "&", "+", "-", "*"):  # weakest first
            sides = split_top(ts, op)
            if len(sides) < 2 or not all(sides):
                continue
            values = [evaluate(x, ctx) for x in sides]
            if op in "*&" and 0 in values:
                return []
            if len(sides) == 2:
                a, b = text_of(sides[0]), text_of(sides[1])
                same, negated = a == b, a == "~" + b or b == "~" + a
                if (op in "-^&" and same) or (op in "&|" and negated) or (op == "*" and 1 in values) or (op == "+" and 0 in values):
                    return []
            return list(dict.fromkeys(x for side in sides for x in self.effective(side, ctx)))
        return self.roots(ts, ctx)

    def _edge(self, src: str, dst: str, kind: str, line: int) -> None:
        if src != dst:
            self.out.edges.append(Edge(src, dst, kind, line))

    def _assign(self, ts: list[Tok], ctx: dict[str, str], kind: str) -> None:
        eq = next((i for i, t in enumerate(ts) if t.text == "="), None)
        if eq is None:
            return
        left, right, line = ts[:eq], ts[eq + 1 :], ts[0].line
        if left and left[0].text == "{":
            a, b = split_top(left[1:-1]), split_top(right[1:-1]) if right and right[0].text == "{" and _match(right, 0) == len(right) else []
            if len(a) != len(b):  # a width mismatch gives no edges at all
                return
            for x, y in zip(a, b):
                for dst, src in product(self.roots(x, ctx), self.effective(y, ctx)):
                    self._edge(src, dst, kind, line)
            return
        targets = self.roots(left, ctx)
        if self.fold and self._constant(right, ctx):
            self.out.constants.update(targets)
            return
        for dst, src in product(targets, self.effective(right, ctx)):
            self._edge(src, dst, kind, line)

    def _gate(self, ts: list[Tok], ctx: dict[str, str]) -> None:
        for part in split_top(ts[1:]):
            k = next((i for i, t in enumerate(part) if t.text == "("), None)
            if k is None:
                continue
            pins = split_top(part[k + 1 : _match(part, k) - 1])
            for dst, pin in product(self.roots(pins[0], ctx) if pins else [], pins[1:]):
                for src in self.roots(pin, ctx):
                    self._edge(src, dst, "gate", part[0].line)

    def _registers(self, s: tuple | None, ctx: dict[str, str], top: bool) -> list[tuple[str, str, int]]:
        if s is None:
            return []
        if s[0] == "block":
            return [x for inner in s[2] for x in self._registers(inner, ctx, top)]
        if s[0] == "if":
            v = evaluate(s[1], ctx)
            arms = (s[2], s[3]) if v is None else (s[2] if v else s[3],)
            return [x for arm in arms for x in self._registers(arm, ctx, top)]
        if s[0] == "case":
            return [x for _, arm in s[3] for x in self._registers(arm, ctx, top)]
        if s[0] == "for":
            return self._registers(s[2], ctx, top)
        if s[0] == "simple" and s[1]:
            at = next((i for i, t in enumerate(s[1]) if t.text in ("<=", "=")), None)
            if at is not None:
                return [(src, dst, s[1][0].line) for dst in self.roots(s[1][:at], ctx) for src in self.effective(s[1][at + 1 :], ctx)]
        return []

    def _combinational(self, s: tuple | None, ctx: dict[str, str], last: dict[str, tuple[list[str], int]]) -> None:
        """Sources of each target; in a straight line of statements the last assignment wins, branches add up."""
        if s is None:
            return
        if s[0] == "block":
            for inner in s[2]:
                self._combinational(inner, ctx, last)
        elif s[0] in ("if", "case"):
            if s[0] == "if":
                v = evaluate(s[1], ctx)
                arms = [s[2], s[3]] if v is None and self.over else [s[3]] if v is None else [s[2] if v else s[3]]
            else:
                v = evaluate(s[2], ctx)
                chosen = next((arm for labels, arm in s[3] if labels is None or any(evaluate(x, ctx) == v for x in labels)), None) if v is not None else None
                arms = [chosen] if v is not None else [] if s[1] != "case" else [arm for _, arm in s[3]]
            merged: dict[str, tuple[list[str], int]] = {}
            for arm in arms:
                own: dict[str, tuple[list[str], int]] = {}
                self._combinational(arm, ctx, own)
                for k, (sources, line) in own.items():
                    merged[k] = (list(dict.fromkeys([*merged.get(k, ([], 0))[0], *sources])), line)
            last.update(merged)
        elif s[0] == "for":
            self._combinational(s[2], ctx, last)
        elif s[0] == "simple" and s[1]:
            at = next((i for i, t in enumerate(s[1]) if t.text in ("=", "<=")), None)
            if at is not None:
                for dst in self.roots(s[1][:at], ctx):
                    last[dst] = (self.effective(s[1][at + 1 :], ctx), s[1][0].line)
