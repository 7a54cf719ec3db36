"""Chat formatting: a template compiler and a streaming formatter over conversations.

The template language is a closed one: text, ``{{ expression }}``, ``{% if %} {% elif %} {% else %}
{% endif %}``, ``{% for name in messages %} {% endfor %}`` and ``{% generation %} {% endgeneration %}``,
which marks what a model is trained on. Expressions know the loop variable's ``role`` and ``text``,
``loop.first``, ``loop.last`` and ``loop.index``, string, integer and boolean literals, ``== !=``,
``~`` (joins strings), ``and or not``, parentheses and the filters ``escape upper lower trim``. There
are no calls, attributes of other objects, imports or assignments, so a template can reach nothing else.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python closures
that append pieces to an output, each piece with its mark. A template has one loop over messages,
so that a conversation can be formatted turn by turn: no conversation is ever held whole.

``escape`` makes texts safe: a backslash is doubled, and a backslash is set behind the first
character of every control string, wherever one starts. ``unescape`` undoes that exactly.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What a text must never hold unescaped: this template's own marks and those of other common ones.
CONTROLS = (START, SEPARATOR, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape }}<|im_sep|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|im_end|>{% endfor %}"
)

_HEADS = re.compile("(?=" + "|".join(re.escape(c) for c in CONTROLS) + ")(.)", re.S)


def escape(text: str) -> str:
    return _HEADS.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class TemplateError(ValueError):
    """The template is not in the language."""


@dataclass(frozen=True)
class Node:
    kind: str
    value: Any = None
    parts: tuple = ()


_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKENS = re.compile(r"\s*(?:(\d+)|'([^']*)'|\"([^\"]*)\"|([A-Za-z_]\w*)|(==|!=|[~|.()]))")
_FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "upper": str.upper, "lower": str.lower, "trim": str.strip}
_FIELDS = {"role", "text"}
_LOOP = {"first", "last", "index"}


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str, loop: str | None):
        self.loop, self.tokens, at = loop, [], 0
        while source[at:].strip():
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            number, one, two, name, sign = m.groups()
            self.tokens.append(("int", int(number)) if number else ("str", one if one is not None else two) if name is None and sign is None else ("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def take(self, kind: str, value=None):
        if self.at < len(self.tokens) and self.tokens[self.at][0] == kind and value in (None, self.tokens[self.at][1]):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, kind: str, value=None):
        found = self.take(kind, value)
        if found is None:
            raise TemplateError(f"{value or kind} expected")
        return found

    def whole(self) -> Node:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("name", "or"):
            node = Node("or", parts=(node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("name", "and"):
            node = Node("and", parts=(node, self.negated()))
        return node

    def negated(self) -> Node:
        return Node("not", parts=(self.negated(),)) if self.take("name", "not") else self.compared()

    def compared(self) -> Node:
        node = self.joined()
        for sign in ("==", "!="):
            if self.take("sign", sign):
                return Node(sign, parts=(node, self.joined()))
        return node

    def joined(self) -> Node:
        node = self.filtered()
        while self.take("sign", "~"):
            node = Node("~", parts=(node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while self.take("sign", "|"):
            name = self.need("name")
            if name not in _FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            node = Node("filter", name, (node,))
        return node

    def atom(self) -> Node:
        for kind in ("int", "str"):
            if (found := self.take(kind)) is not None:
                return Node("const", found)
        if self.take("sign", "("):
            node = self.either()
            self.need("sign", ")")
            return node
        name = self.need("name")
        if name in ("true", "false"):
            return Node("const", name == "true")
        if self.loop is not None and name in (self.loop, "loop"):
            self.need("sign", ".")
            field = self.need("name")
            if field not in (_LOOP if name == "loop" else _FIELDS):
                raise TemplateError(f"unknown field {name}.{field}")
            return Node("loop" if name == "loop" else "field", field)
        raise TemplateError(f"unknown name {name!r}")


def parse(template: str) -> Node:
    """The syntax tree of a template."""
    pieces, at = [], 0
    for m in _TAGS.finditer(template):
        if m.start() > at:
            pieces.append(("text", template[at : m.start()]))
        pieces.append(("value", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(template):
        pieces.append(("text", template[at:]))
    if any("{%" in p or "{{" in p for k, p in pieces if k == "text"):
        raise TemplateError("a tag is not closed")
    position = 0

    def block(loop: str | None, ends: tuple[str, ...], generation: bool) -> tuple[Node, str]:
        nonlocal position
        out = []
        while position < len(pieces):
            kind, source = pieces[position]
            position += 1
            if kind == "text":
                out.append(Node("text", source))
            elif kind == "value":
                out.append(Node("print", parts=(_Expression(source, loop).whole(),)))
            else:
                word, _, rest = source.partition(" ")
                if word in ends:
                    return Node("block", parts=tuple(out)), source
                if word == "if":
                    out.append(branches(loop, rest, generation))
                elif word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*) in messages", rest.strip())
                    if not m or loop is not None or m[1] in ("loop", "true", "false", "not", "and", "or"):
                        raise TemplateError(f"cannot loop over {rest!r}")
                    body, _ = block(m[1], ("endfor",), generation)
                    out.append(Node("for", m[1], (body,)))
                elif word == "generation" and not generation:
                    body, _ = block(loop, ("endgeneration",), True)
                    out.append(Node("generation", parts=(body,)))
                else:
                    raise TemplateError(f"unexpected {source!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return Node("block", parts=tuple(out)), ""

    def branches(loop: str | None, condition: str, generation: bool) -> Node:
        test = _Expression(condition, loop).whole()
        body, end = block(loop, ("elif", "else", "endif"), generation)
        word, _, rest = end.partition(" ")
        if word == "elif":
            return Node("if", parts=(test, body, branches(loop, rest, generation)))
        other = block(loop, ("endif",), generation)[0] if word == "else" else Node("block")
        return Node("if", parts=(test, body, other))

    return block(None, (), False)[0]


def _text(value) -> str:
    return "true" if value is True else "false" if value is False else str(value)


def fold(node: Node) -> Node:
    """The tree with constant expressions, branches and adjacent texts worked out."""
    parts = tuple(fold(p) for p in node.parts)
    consts = [p.value for p in parts] if parts and all(p.kind == "const" for p in parts) else None
    if node.kind in ("and", "or") and parts[0].kind == "const":
        return parts[1] if bool(parts[0].value) == (node.kind == "and") else parts[0]
    if consts is not None:
        if node.kind == "not":
            return Node("const", not consts[0])
        if node.kind in ("==", "!="):
            return Node("const", (consts[0] == consts[1]) == (node.kind == "=="))
        if node.kind == "~":
            return Node("const", _text(consts[0]) + _text(consts[1]))
        if node.kind == "filter":
            return Node("const", _FILTERS[node.value](_text(consts[0])))
        if node.kind == "print":
            return Node("text", _text(consts[0]))
    if node.kind == "if" and parts[0].kind == "const":
        return parts[1] if parts[0].value else parts[2]
    if node.kind == "block":
        flat: list[Node] = []
        for p in parts:
            for q in p.parts if p.kind == "block" else (p,):
                if q.kind == "text" and flat and flat[-1].kind == "text":
                    flat[-1] = Node("text", flat[-1].value + q.value)
                elif q.kind != "text" or q.value:
                    flat.append(q)
        return Node("block", parts=tuple(flat))
    return Node(node.kind, node.value, parts)


@dataclass
class Turn:
    role: str
    text: str
    first: bool
    last: bool
    index: int


Piece = tuple[str, bool]
Emit = Callable[[Turn | None, list[Piece]], None]


def _value(node: Node) -> Callable[[Turn], Any]:
    kind = node.kind
    if kind == "const":
        return lambda turn, v=node.value: v
    if kind in ("field", "loop"):
        return lambda turn, name=node.value: getattr(turn, name)
    inner = [_value(p) for p in node.parts]
    if kind == "filter":
        return lambda turn, f=_FILTERS[node.value], a=inner[0]: f(_text(a(turn)))
    if kind == "not":
        return lambda turn, a=inner[0]: not a(turn)
    a, b = inner
    return {
        "and": lambda turn: a(turn) and b(turn),
        "or": lambda turn: a(turn) or b(turn),
        "==": lambda turn: a(turn) == b(turn),
        "!=": lambda turn: a(turn) != b(turn),
        "~": lambda turn: _text(a(turn)) + _text(b(turn)),
    }[kind]


def _emitter(node: Node, marked: bool = False) -> Emit:
    if node.kind == "text":
        return lambda turn, out, piece=(node.value, marked): out.append(piece)
    if node.kind == "print":
        value = _value(node.parts[0])
        return lambda turn, out: out.append((_text(value(turn)), marked))
    if node.kind == "generation":
        return _emitter(node.parts[0], True)
    if node.kind == "if":
        test, yes, no = _value(node.parts[0]), _emitter(node.parts[1], marked), _emitter(node.parts[2], marked)
        return lambda turn, out: yes(turn, out) if test(turn) else no(turn, out)
    if node.kind == "for":
        raise TemplateError("a template has one loop over messages, outside of all other tags")
    inner = [_emitter(p, marked) for p in node.parts]

    def run(turn, out):
        for emit in inner:
            emit(turn, out)

    return run


@dataclass
class Template:
    """Closures for what stands before, in and after the loop over messages."""

    before: Emit
    turn: Emit
    after: Emit

    def render(self, messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """(text, spans of marked text) of a whole conversation of (role, text)."""
        out: list[Piece] = []
        self.before(None, out)
        for i, (role, text) in enumerate(messages):
            self.turn(Turn(role, text, i == 0, i == len(messages) - 1, i + 1), out)
        self.after(None, out)
        return "".join(p for p, _ in out), spans(out)


def spans(pieces: list[Piece]) -> list[tuple[int, int]]:
    """Ranges of the marked pieces in the joined text; touching ones stay apart."""
    out, at = [], 0
    for text, marked in pieces:
        if marked and text:
            out.append((at, at + len(text)))
        at += len(text)
    return out


def compile_template(source: str) -> Template:
    tree = fold(parse(source))
    loops = [k for k, n in enumerate(tree.parts) if n.kind == "for"]
    if len(loops) != 1:
        raise TemplateError("a template has one loop over messages, outside of all other tags")
    k = loops[0]
    return Template(_emitter(Node("block", parts=tree.parts[:k])), _emitter(tree.parts[k].parts[0]), _emitter(Node("block", parts=tree.parts[k + 1 :])))
