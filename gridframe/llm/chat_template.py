"""A sandboxed template language for chats, compiled to Python closures.

Source is cut into tokens and parsed into a tree of tuples ``(kind, ...)``; constant parts are
folded; what is left becomes closures. Nothing of a template is ever evaluated as Python:

* values are texts, numbers, booleans, none, lists and mappings; ``a.b`` and ``a[b]`` look
  into mappings and lists only, never at attributes of objects;
* calls are those of ``FILTERS``, ``TESTS``, ``METHODS`` and ``FUNCTIONS``;
* repetition and ranges are bounded by ``MAX_REPEAT``, so a small template cannot grow
  without data.

Statements: ``{{ e }}``, ``{% if %}``, ``{% for x in e %}``, ``{% set x = e %}``,
``{% generation %}`` (marks what a model learns from), ``{# comments #}``; a ``-`` inside a
mark trims white space on that side.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable, Iterable, Iterator

MAX_REPEAT = 10_000


class TemplateError(ValueError):
    """A template that cannot be parsed, or that does what it may not."""


class Undefined:
    """The value of names and fields that are not there: empty as text, false as a condition."""

    def __bool__(self) -> bool:
        return False

    def __str__(self) -> str:
        return ""

    def __iter__(self) -> Iterator:
        return iter(())


UNDEFINED = Undefined()

# ---------------------------------------------------------------- tokens

_MARK = re.compile(r"\{\{-?|\{%-?|\{#")
_TOKEN = re.compile(
    r"""\s+|(?P<number>\d+(?:\.\d+)?)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|//|[-+*/%~<>()\[\]{}.,:|=])""",
    re.S,
)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}


def _unquote(quoted: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[1]), quoted[1:-1], flags=re.S)


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at]!r} in {source!r}")
        at = m.end()
        if m["number"]:
            out.append(("const", float(m["number"]) if "." in m["number"] else int(m["number"])))
        elif m["string"]:
            out.append(("const", _unquote(m["string"])))
        elif m["name"]:
            out.append(("name", m["name"]))
        elif m["sign"]:
            out.append(("sign", m["sign"]))
    return out


def _pieces(source: str) -> list[tuple[str, str]]:
    """('text', s), ('print', inside) and ('do', inside), white space trimmed as asked."""
    out, at, trim = [], 0, False
    while True:
        m = _MARK.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if trim:
            text = text.lstrip()
        if m and m[0].endswith("-"):
            text = text.rstrip()
        if text:
            out.append(("text", text))
        if not m:
            return out
        close = {"{{": "}}", "{%": "%}", "{#": "#}"}[m[0][:2]]
        # a closing mark inside a string does not close
        end = m.end() if close == "#}" else _skip_strings(source, m.end(), close)
        end = source.find(close, end)
        if end < 0:
            raise TemplateError(f"{m[0]} is not closed")
        inside = source[m.end() : end]
        trim = inside.endswith("-") and close != "#}"
        if close != "#}":
            out.append(("print" if close == "}}" else "do", inside[:-1] if trim else inside))
        at = end + 2


def _skip_strings(source: str, at: int, close: str) -> int:
    while at < len(source) and not source.startswith(close, at):
        if source[at] in "\"'":
            m = _TOKEN.match(source, at)
            if not m or not m["string"]:
                raise TemplateError("a string is not closed")
            at = m.end()
        else:
            at += 1
    return at


# ---------------------------------------------------------------- syntax tree

_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self, *signs: str) -> str | None:
        if self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            if kind != "const" and value in signs:
                return value
        return None

    def take(self, *signs: str) -> str | None:
        if found := self.peek(*signs):
            self.at += 1
        return found

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} expected")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name expected")

    def whole(self):
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def choice(self):
        value = self.any()
        if self.take("if"):
            test = self.any()
            return ("choice", test, value, self.choice() if self.take("else") else ("const", UNDEFINED))
        return value

    def any(self):
        left = self.all()
        while self.take("or"):
            left = ("or", left, self.all())
        return left

    def all(self):
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        while True:
            if sign := self.take(*_COMPARE):
                left = ("op", sign, left, self.joined())
            elif self.take("in"):
                left = ("op", "in", left, self.joined())
            elif self.peek("not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                left = ("not", ("op", "in", left, self.joined()))
            elif self.take("is"):
                negative = self.take("not")
                name = self.name()
                if name not in TESTS:
                    raise TemplateError(f"no test {name!r}")
                left = ("test", name, left)
                left = ("not", left) if negative else left
            else:
                return left

    def joined(self):
        left = self.added()
        while self.take("~"):
            left = ("op", "~", left, self.added())
        return left

    def added(self):
        left = self.times()
        while sign := self.take("+", "-"):
            left = ("op", sign, left, self.times())
        return left

    def times(self):
        left = self.signed()
        while sign := self.take("*", "/", "//", "%"):
            left = ("op", sign, left, self.signed())
        return left

    def signed(self):
        return ("op", "-", ("const", 0), self.signed()) if self.take("-") else self.followed()

    def followed(self):
        value = self.primary()
        while True:
            if self.take("."):
                name = self.name()
                value = ("method", name, value, self.arguments()) if self.take("(") else ("field", value, ("const", name))
            elif self.take("["):
                start = None if self.peek(":") else self.choice()
                if self.take(":"):
                    stop = None if self.peek("]") else self.choice()
                    value = ("cut", value, start or ("const", None), stop or ("const", None))
                else:
                    value = ("field", value, start)
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                value = ("filter", name, value, self.arguments() if self.take("(") else [])
            else:
                return value

    def arguments(self) -> list:
        out = []
        while not self.take(")"):
            out.append(self.choice())
            if not self.peek(")"):
                self.need(",")
        return out

    def primary(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too soon")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "const":
            return ("const", value)
        if kind == "name":
            known = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            if value in known:
                return ("const", known[value])
            if self.take("("):
                if value not in FUNCTIONS:
                    raise TemplateError(f"no function {value!r}")
                return ("call", value, self.arguments())
            return ("name", value)
        if value == "(":
            inner = self.choice()
            self.need(")")
            return inner
        if value == "[":
            items = []
            while not self.take("]"):
                items.append(self.choice())
                if not self.peek("]"):
                    self.need(",")
            return ("list", items)
        if value == "{":
            pairs = []
            while not self.take("}"):
                key = self.choice()
                self.need(":")
                pairs.append((key, self.choice()))
                if not self.peek("}"):
                    self.need(",")
            return ("dict", pairs)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list:
    """The statements of a template."""
    pieces = _pieces(source)
    body, rest = _block(pieces, 0, ())
    if rest < len(pieces):
        raise TemplateError(f"unexpected {pieces[rest][1].strip()!r}")
    return body


def _word(piece: tuple[str, str]) -> tuple[str, str]:
    parts = piece[1].strip().split(None, 1)
    return (parts[0] if parts else "", parts[1] if len(parts) > 1 else "")


def _block(pieces: list, at: int, ends: tuple[str, ...]) -> tuple[list, int]:
    out = []
    while at < len(pieces):
        kind, inside = pieces[at]
        if kind == "text":
            out.append(("text", inside))
            at += 1
            continue
        if kind == "print":
            out.append(("print", _Expression(inside).whole()))
            at += 1
            continue
        word, rest = _word(pieces[at])
        if word in ends:
            return out, at
        if word == "set":
            name, _, value = rest.partition("=")
            if not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                raise TemplateError(f"cannot set {name.strip()!r}")
            out.append(("set", name.strip(), _Expression(value).whole()))
            at += 1
        elif word == "if":
            branches, otherwise = [], []
            while word in ("if", "elif"):
                test = _Expression(rest).whole()
                body, at = _block(pieces, at + 1, ("elif", "else", "endif"))
                branches.append((test, body))
                word, rest = _word(pieces[at]) if at < len(pieces) else ("", "")
            if word == "else":
                otherwise, at = _block(pieces, at + 1, ("endif",))
            at = _end(pieces, at, "endif")
            out.append(("if", branches, otherwise))
        elif word == "for":
            name, found, value = rest.partition(" in ")
            if not found or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                raise TemplateError(f"cannot loop {rest!r}")
            body, at = _block(pieces, at + 1, ("else", "endfor"))
            otherwise = []
            if at < len(pieces) and _word(pieces[at])[0] == "else":
                otherwise, at = _block(pieces, at + 1, ("endfor",))
            at = _end(pieces, at, "endfor")
            out.append(("for", name.strip(), _Expression(value).whole(), body, otherwise))
        elif word == "generation":
            body, at = _block(pieces, at + 1, ("endgeneration",))
            at = _end(pieces, at, "endgeneration")
            out.append(("generation", body))
        else:
            raise TemplateError(f"no statement {word!r}")
    return out, at


def _end(pieces: list, at: int, word: str) -> int:
    if at >= len(pieces) or _word(pieces[at])[0] != word:
        raise TemplateError(f"{word} expected")
    return at + 1


# ---------------------------------------------------------------- what templates may call


def _bounded(a, n: int):
    if isinstance(n, int) and n > MAX_REPEAT:
        raise TemplateError(f"more than {MAX_REPEAT} repetitions")
    return a * n


def _times(a, b):
    if isinstance(a, (str, list)):
        return _bounded(a, b)
    return _bounded(b, a) if isinstance(b, (str, list)) else a * b


def _modulo(a, b):
    if isinstance(a, str):
        raise TemplateError("texts are not formatted by %")
    return a % b


def _contains(a, b) -> bool:
    return not isinstance(b, Undefined) and a in b


def _range(*ends: int) -> range:
    out = range(*ends)
    if len(out) > MAX_REPEAT:
        raise TemplateError(f"more than {MAX_REPEAT} repetitions")
    return out


def _raise(message: object = "") -> None:
    raise TemplateError(str(message))


#: Control marks open with this pair of signs.
_OPENS = re.compile(r"<(\\*)\|")
_OPENED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    r"""``text`` without ``<|``: ``<``, any backslashes, ``|`` get one backslash more. ``unescape`` takes it away."""
    return _OPENS.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _OPENED.sub(r"<\1|", text) if "<" in text else text


def escape_line(text: str) -> str:
    """``escape``, on one line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text), flags=re.S)


def text_of(value: object) -> str:
    if value is None:
        return "None"
    return value if isinstance(value, str) else str(value)


FILTERS: dict[str, Callable] = {
    "trim": lambda v: text_of(v).strip(), "upper": lambda v: text_of(v).upper(), "lower": lambda v: text_of(v).lower(), "length": len, "count": len, "first": lambda v: next(iter(v), UNDEFINED), "last": lambda v: v[-1] if v else UNDEFINED,
    "default": lambda v, other="": other if isinstance(v, Undefined) else v, "join": lambda v, by="": text_of(by).join(map(text_of, v)), "replace": lambda v, a, b: text_of(v).replace(a, b), "string": text_of, "int": int, "list": list, "tojson": lambda v: json.dumps(v, ensure_ascii=False),
    "escape": lambda v: escape(text_of(v)), "escape_line": lambda v: escape_line(text_of(v)),
}
TESTS: dict[str, Callable] = {
    "defined": lambda v: not isinstance(v, Undefined), "undefined": lambda v: isinstance(v, Undefined), "none": lambda v: v is None, "string": lambda v: isinstance(v, str), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "mapping": lambda v: isinstance(v, dict), "iterable": lambda v: isinstance(v, (str, list, tuple, dict, range)),
    "true": lambda v: v is True, "false": lambda v: v is False, "even": lambda v: v % 2 == 0, "odd": lambda v: v % 2 == 1,
}
#: Methods of texts; mappings have ``get``, ``keys``, ``values`` and ``items``.
METHODS: dict[str, Callable] = {
    "strip": str.strip, "lstrip": str.lstrip, "rstrip": str.rstrip, "upper": str.upper, "lower": str.lower, "title": str.title, "capitalize": str.capitalize, "startswith": str.startswith, "endswith": str.endswith, "split": str.split, "replace": str.replace,
}
_OF_MAPPINGS = {"get": dict.get, "keys": lambda d: list(d), "values": lambda d: list(d.values()), "items": lambda d: [list(x) for x in d.items()]}
FUNCTIONS: dict[str, Callable] = {"range": _range, "raise_exception": _raise}

_BINARY: dict[str, Callable] = _COMPARE | {"in": _contains, "~": lambda a, b: text_of(a) + text_of(b), "+": operator.add, "-": operator.sub, "*": _times, "/": operator.truediv, "//": operator.floordiv, "%": _modulo}


def _call_method(name: str, value: object, arguments: list) -> object:
    table, kind = (_OF_MAPPINGS, dict) if isinstance(value, dict) else (METHODS, str)
    if not isinstance(value, kind) or name not in table:
        raise TemplateError(f"no method {name!r} here")
    return table[name](value, *arguments)


def _field(value: object, key: object) -> object:
    if isinstance(value, dict):
        return value.get(key, UNDEFINED)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else UNDEFINED
    return UNDEFINED


# ---------------------------------------------------------------- folding

_IMPURE = {"raise_exception"}


def fold(tree):
    """The tree with constant expressions evaluated, dead branches gone and texts joined."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind in ("list", "dict"):
        parts = [fold(x) for x in tree[1]] if kind == "list" else [(fold(k), fold(v)) for k, v in tree[1]]
        return (kind, parts)  # a fresh value at each evaluation
    if kind == "choice":
        test = fold(tree[1])
        return fold(tree[2] if test[1] else tree[3]) if test[0] == "const" else ("choice", test, fold(tree[2]), fold(tree[3]))
    if kind in ("and", "or"):
        left = fold(tree[1])
        if left[0] == "const":
            return fold(tree[2]) if bool(left[1]) == (kind == "and") else left
        return (kind, left, fold(tree[2]))
    rebuilt = tuple(fold(x) if isinstance(x, tuple) else [fold(y) for y in x] if isinstance(x, list) else x for x in tree)
    below = [y for x in rebuilt[1:] for y in (x if isinstance(x, list) else [x]) if isinstance(y, tuple)]
    if all(x[0] == "const" for x in below) and not (kind == "call" and tree[1] in _IMPURE):
        try:
            value = _compile(rebuilt)({})
        except Exception:  # it fails where and when it is reached, as it would unfolded
            return rebuilt
        if isinstance(value, (str, int, float, bool, type(None))):
            return ("const", value)
    return rebuilt


def fold_body(body: list) -> list:
    out: list = []
    for s in body:
        kind = s[0]
        if kind == "print":
            value = fold(s[1])
            s = ("text", text_of(value[1])) if value[0] == "const" else ("print", value)
        elif kind == "set":
            s = ("set", s[1], fold(s[2]))
        elif kind == "for":
            s = ("for", s[1], fold(s[2]), fold_body(s[3]), fold_body(s[4]))
        elif kind == "generation":
            s = ("generation", fold_body(s[1]))
        elif kind == "if":
            branches, otherwise = [], fold_body(s[2])
            for test, inner in s[1]:
                test = fold(test)
                if test[0] != "const":
                    branches.append((test, fold_body(inner)))
                elif test[1]:
                    otherwise = fold_body(inner)
                    break
            if not branches:
                out += otherwise
                continue
            s = ("if", branches, otherwise)
        out.append(s)
    joined: list = []
    for s in out:
        if s[0] == "text" and joined and joined[-1][0] == "text":
            joined[-1] = ("text", joined[-1][1] + s[1])
        elif s != ("text", ""):
            joined.append(s)
    return joined


# ---------------------------------------------------------------- closures


def _compile(tree) -> Callable[[dict], object]:
    """A closure from the names' values to the value of an expression."""
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda names: value
    if kind == "name":
        name = tree[1]
        return lambda names: names.get(name, UNDEFINED)
    if kind == "list":
        items = [_compile(x) for x in tree[1]]
        return lambda names: [x(names) for x in items]
    if kind == "dict":
        pairs = [(_compile(k), _compile(v)) for k, v in tree[1]]
        return lambda names: {k(names): v(names) for k, v in pairs}
    if kind == "choice":
        test, one, other = map(_compile, tree[1:])
        return lambda names: one(names) if test(names) else other(names)
    if kind == "and":
        a, b = _compile(tree[1]), _compile(tree[2])
        return lambda names: a(names) and b(names)
    if kind == "or":
        a, b = _compile(tree[1]), _compile(tree[2])
        return lambda names: a(names) or b(names)
    if kind == "not":
        a = _compile(tree[1])
        return lambda names: not a(names)
    if kind == "op":
        f, a, b = _BINARY[tree[1]], _compile(tree[2]), _compile(tree[3])
        return lambda names: f(a(names), b(names))
    if kind == "field":
        a, b = _compile(tree[1]), _compile(tree[2])
        return lambda names: _field(a(names), b(names))
    if kind == "cut":
        a, b, c = map(_compile, tree[1:])
        return lambda names: a(names)[b(names) : c(names)]
    if kind == "test":
        f, a = TESTS[tree[1]], _compile(tree[2])
        return lambda names: f(a(names))
    if kind == "filter":
        f, a, rest = FILTERS[tree[1]], _compile(tree[2]), [_compile(x) for x in tree[3]]
        return (lambda names: f(a(names), *[x(names) for x in rest])) if rest else (lambda names: f(a(names)))
    if kind == "method":
        name, a, rest = tree[1], _compile(tree[2]), [_compile(x) for x in tree[3]]
        return lambda names: _call_method(name, a(names), [x(names) for x in rest])
    f, rest = FUNCTIONS[tree[1]], [_compile(x) for x in tree[2]]
    return lambda names: f(*[x(names) for x in rest])


class Output:
    """Rendered text and the spans (in code points) of generation blocks."""

    def __init__(self):
        self.pieces: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)


def _writer(text: str) -> Callable[[dict, Output], None]:
    return lambda names, out: out.write(text)


def _printer(value: Callable[[dict], object]) -> Callable[[dict, Output], None]:
    return lambda names, out: out.write(text_of(value(names)))


def _compile_body(body: list) -> Callable[[dict, Output], None]:
    steps = [_statement(s) for s in body]
    if len(steps) == 1:
        return steps[0]

    def run(names: dict, out: Output) -> None:
        for step in steps:
            step(names, out)

    return run


def _statement(s: tuple) -> Callable[[dict, Output], None]:
    kind = s[0]
    if kind == "text":
        return _writer(s[1])
    if kind == "print":
        return _printer(_compile(s[1]))
    if kind == "set":
        name, value = s[1], _compile(s[2])
        return lambda names, out: names.__setitem__(name, value(names))
    if kind == "if":
        branches, otherwise = [(_compile(t), _compile_body(b)) for t, b in s[1]], _compile_body(s[2])

        def choose(names: dict, out: Output) -> None:
            for test, body in branches:
                if test(names):
                    return body(names, out)
            return otherwise(names, out)

        return choose
    if kind == "generation":
        inner = _compile_body(s[1])

        def marked(names: dict, out: Output) -> None:
            start = out.size
            inner(names, out)
            if out.size > start:
                out.spans.append((start, out.size))

        return marked
    steps = _loop(s)

    def loop(names: dict, out: Output) -> None:
        for _ in steps(names, out):
            pass

    return loop


def _loop(s: tuple) -> Callable[[dict, Output], Iterator[None]]:
    """A loop that stops after each turn, so a caller can take what is written."""
    name, items, body, otherwise = s[1], _compile(s[2]), _compile_body(s[3]), _compile_body(s[4])
    uses_length = any(x in str(s[3]) for x in ("'length'", "'revindex'", "'revindex0'"))

    def run(names: dict, out: Output) -> Iterator[None]:
        values = items(names)
        size = len(values) if hasattr(values, "__len__") and uses_length else 0
        inner, count, it = dict(names), 0, iter(values)
        at = next(it, UNDEFINED)
        while at is not UNDEFINED:
            later = next(it, UNDEFINED)
            inner |= names
            inner[name] = at
            inner["loop"] = {"index": count + 1, "index0": count, "first": not count, "last": later is UNDEFINED, "length": size, "revindex": size - count, "revindex0": size - count - 1}
            body(inner, out)
            at, count = later, count + 1
            yield
        if not count:
            otherwise(names, out)

    return run


def _mentions(tree, name: str) -> int:
    """How often a tree reads a name."""
    if isinstance(tree, tuple):
        return 1 if tree[:2] == ("name", name) and len(tree) == 2 else sum(_mentions(x, name) for x in tree)
    return sum(_mentions(x, name) for x in tree) if isinstance(tree, list) else 0


class Template:
    """A compiled template.

    It is ``streaming`` if it reads its messages in one outer loop and nowhere else, and
    does not ask for their number: then it needs one message (and the next) at a time.
    """

    def __init__(self, source: str, messages: str = "messages"):
        self.body, self.messages = fold_body(parse(source)), messages
        outer = [s for s in self.body if s[0] == "for" and s[2] == ("name", messages)]
        counted = any(x in str(self.body) for x in ("'length'", "'revindex'", "'revindex0'"))
        self.streaming = len(outer) == 1 and _mentions(self.body, messages) == 1 and not counted
        self._steps = [_loop(s) if s in outer else _statement(s) for s in self.body]
        self._loops = [s in outer for s in self.body]

    def parts(self, messages: Iterable[dict], part_chars: int, **names: object) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Text and generation spans in parts of some ``part_chars``, cut between turns of the outer loop; spans count within their part."""
        out, given = Output(), dict(names)
        given[self.messages] = messages if self.streaming else list(messages)
        for step, loops in zip(self._steps, self._loops):
            for _ in step(given, out) if loops else [step(given, out)]:
                if out.size >= part_chars:
                    yield "".join(out.pieces), out.spans
                    out.__init__()
        if out.size:
            yield "".join(out.pieces), out.spans

    def render(self, messages: Iterable[dict], **names: object) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and its generation spans."""
        return next(self.parts(messages, 1 << 62, **names), ("", []))
