"""The keyword language and the pattern language. Both give the commands of :mod:`quillgraph.plans.commands`.

Shared: keywords in any case, N<digits> and E<digits> as written, text in double quotes without escapes, conditions
joined by AND, all of which count. Input that goes on after a complete command is an error.
"""

from __future__ import annotations

import re
from typing import Protocol

from quillgraph.errors import ParseError
from quillgraph.functions.compare import Literal
from quillgraph.plans.commands import Command, Condition, CountEdges, CountNodes, GetEdge, GetNode, MatchEdges, MatchNodes, ShortestPath, Traverse

_TOKEN = re.compile(r'\s*(?:"([^"]*)"|(<=|>=|!=|<>|->|[=<>()\[\]{}:,.*-])|([^\s"=<>!()\[\]{}:,]+))')


class Language(Protocol):
    name: str

    def parse(self, text: str) -> Command: ...


class _Tokens:
    """(kind, text) with kind text, sign or word."""

    def __init__(self, name: str, items: list[tuple[str, str]]) -> None:
        self.name, self.items, self.at = name, items, 0

    def fail(self, why: str) -> ParseError:
        return ParseError(f"[{self.name}] {why}")

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self) -> tuple[str, str]:
        found = self.peek()
        self.at += 1
        return found

    def keyword(self, *words: str) -> str | None:
        kind, text = self.peek()
        if kind == "word" and text.upper() in words:
            self.at += 1
            return text.upper()
        return None

    def sign(self, *signs: str) -> str | None:
        kind, text = self.peek()
        if kind == "sign" and text in signs:
            self.at += 1
            return text
        return None

    def need(self, sign: str) -> None:
        if not self.sign(sign):
            raise self.fail(f"expected {sign!r}, found {self.peek()[1] or 'the end'!r}")

    def word(self, what: str) -> str:
        kind, text = self.take()
        if kind != "word":
            raise self.fail(f"expected {what}, found {text or 'the end'!r}")
        return text

    def operator(self) -> str:
        found = self.sign("=", "!=", "<>", "<=", ">=", "<", ">")
        if not found:
            raise self.fail(f"expected a comparison, found {self.peek()[1] or 'the end'!r}")
        return "!=" if found == "<>" else found

    def reference(self, prefix: str) -> int:
        text = self.word(f"{prefix}<digits>")
        if not re.fullmatch(prefix + r"[0-9]+", text):
            raise self.fail(f"expected {prefix}<digits>, found {text!r}")
        n = int(text[1:])
        if n >= 1 << 63:
            raise self.fail(f"{text} is beyond the largest id")
        return n

    def end(self) -> None:
        if self.at < len(self.items):
            raise self.fail(f"unexpected {self.peek()[1]!r} after the command")


def _number(tokens: _Tokens, text: str) -> Literal:
    try:
        if "." in text:
            return float(text)
        n = int(text)
    except ValueError:
        raise tokens.fail(f"{text!r} is no value") from None
    if not -(1 << 63) <= n < 1 << 63 or not re.fullmatch(r"[+-]?[0-9]+", text):
        raise tokens.fail(f"{text!r} is no 64-bit integer")
    return n


def _walk(tokens: _Tokens) -> Command | None:
    """The commands that both languages write alike."""
    if tokens.keyword("TRAVERSE"):
        kind = tokens.keyword("BFS", "DFS")
        if not kind or not tokens.keyword("FROM"):
            raise tokens.fail("expected TRAVERSE BFS|DFS FROM N<id>")
        return Traverse(kind, tokens.reference("N"))
    if tokens.keyword("PATH"):
        if not tokens.keyword("FROM"):
            raise tokens.fail("expected PATH FROM N<id> TO N<id>")
        start = tokens.reference("N")
        if not tokens.keyword("TO"):
            raise tokens.fail("expected TO")
        return ShortestPath(start, tokens.reference("N"))
    if tokens.keyword("COUNT"):
        what = tokens.keyword("NODES", "EDGES")
        if not what:
            raise tokens.fail("expected COUNT NODES|EDGES")
        return CountNodes() if what == "NODES" else CountEdges()
    return None


class SimpleLanguage:
    """MATCH NODE|EDGE [WHERE field op value [AND …]], GET NODE|EDGE, TRAVERSE, PATH and COUNT."""

    name = "SimpleQuery"

    def parse(self, text: str) -> Command:
        items, at = [], 0
        pattern = re.compile(r'\s*(?:"([^"]*)"|(<=|>=|!=|<>|=|<|>)|([^\s"=<>!]+))')
        body = text.rstrip()
        while at < len(body):
            m = pattern.match(body, at)
            if not m:
                raise ParseError(f"[{self.name}] can't read {body[at:].strip()[:20]!r}")
            items.append(next((k, m[i]) for i, k in ((1, "text"), (2, "sign"), (3, "word")) if m[i] is not None))
            at = m.end()
        tokens = _Tokens(self.name, items)
        found = self._command(tokens)
        tokens.end()
        return found

    def _command(self, tokens: _Tokens) -> Command:
        if tokens.keyword("MATCH"):
            what = tokens.keyword("NODE", "EDGE")
            if not what:
                raise tokens.fail("expected MATCH NODE|EDGE")
            conditions: list[Condition] = []
            if tokens.keyword("WHERE"):
                conditions.append(self._condition(tokens, what == "EDGE"))
                while tokens.keyword("AND"):
                    conditions.append(self._condition(tokens, what == "EDGE"))
            return (MatchNodes if what == "NODE" else MatchEdges)(tuple(conditions))
        if tokens.keyword("GET"):
            what = tokens.keyword("NODE", "EDGE")
            if not what:
                raise tokens.fail("expected GET NODE|EDGE")
            return GetNode(tokens.reference("N")) if what == "NODE" else GetEdge(tokens.reference("E"))
        found = _walk(tokens)
        if found is None:
            raise tokens.fail(f"unknown command {tokens.peek()[1]!r}" if tokens.items else "empty query")
        return found

    def _condition(self, tokens: _Tokens, edge: bool) -> Condition:
        name = tokens.word("a field")
        op = tokens.operator()
        if name.lower().startswith("props."):
            if len(name) == 6:
                raise tokens.fail("expected a name after props.")
            return Condition(("prop", name[6:]), op, self._value(tokens))
        if name.lower() == "label":
            kind, text = tokens.take()
            if op != "=" or kind != "text":
                raise tokens.fail('a label only compares as label = "…"')
            return Condition(("label",), op, text)
        if name.lower() == "weight" and edge:
            text = tokens.word("a number")
            try:
                return Condition(("weight",), op, float(text))
            except ValueError:
                raise tokens.fail(f"{text!r} is no number") from None
        raise tokens.fail(f"unknown field {name!r}")

    def _value(self, tokens: _Tokens) -> Literal:
        kind, text = tokens.take()
        if kind == "text":
            return text
        if kind != "word":
            raise tokens.fail(f"expected a value, found {text or 'the end'!r}")
        low = text.lower()
        return {"true": True, "false": False, "null": None}[low] if low in ("true", "false", "null") else _number(tokens, text)


class PatternLanguage:
    """MATCH (v[:L]) or (a)-[r[:L]]->(b) [WHERE v.name op value [AND …]] RETURN …, TRAVERSE, PATH and COUNT."""

    name = "CypherLite"

    def parse(self, text: str) -> Command:
        items, at, body = [], 0, text.rstrip()
        while at < len(body):
            m = _TOKEN.match(body, at)
            if not m:
                raise ParseError(f"[{self.name} lexer] can't read {body[at:].strip()[:20]!r}")
            items.append(next((k, m[i]) for i, k in ((1, "text"), (2, "sign"), (3, "word")) if m[i] is not None))
            at = m.end()
        tokens = _Tokens(self.name, items)
        if not items:
            raise tokens.fail("empty query")
        found = self._match(tokens) if tokens.keyword("MATCH") else _walk(tokens)
        if found is None:
            raise tokens.fail(f"unknown command {tokens.peek()[1]!r}")
        tokens.end()
        return found

    def _element(self, tokens: _Tokens, close: str) -> tuple[str | None, str | None]:
        name = tokens.word("a variable") if tokens.peek()[0] == "word" else None
        label = tokens.word("a label") if tokens.sign(":") else None
        tokens.need(close)
        return name, label

    def _match(self, tokens: _Tokens) -> Command:
        tokens.need("(")
        first, label = self._element(tokens, ")")
        names, edge = {first}, tokens.sign("-")
        if edge:
            tokens.need("[")
            relation, label = self._element(tokens, "]")
            tokens.need("->")
            tokens.need("(")
            names |= {relation, self._element(tokens, ")")[0]}
            subject = relation
        else:
            subject = first
        conditions = [Condition(("label",), "=", label)] if label is not None else []
        if tokens.keyword("WHERE"):
            conditions.append(self._condition(tokens, subject, bool(edge)))
            while tokens.keyword("AND"):
                conditions.append(self._condition(tokens, subject, bool(edge)))
        if not tokens.keyword("RETURN"):
            raise tokens.fail("expected RETURN")
        if tokens.peek()[0] == "end":
            raise tokens.fail("expected something to return")
        while True:  # whole records are returned whatever is listed
            if not tokens.sign("*"):
                tokens.word("a variable")
            if not tokens.sign(","):
                break
        return (MatchEdges if edge else MatchNodes)(tuple(conditions))

    def _condition(self, tokens: _Tokens, subject: str | None, edge: bool) -> Condition:
        text = tokens.word("a variable")
        variable, dot, name = text.partition(".")
        if not dot or not name:
            raise tokens.fail(f"expected variable.property, found {text!r}")
        if variable != subject:
            raise tokens.fail(f"unknown variable {variable!r}")
        op = tokens.operator()
        negative = bool(tokens.sign("-"))
        kind, value = tokens.take()
        if kind == "text" and not negative:
            literal: Literal = value
        elif kind == "word" and value.lower() in ("true", "false", "null") and not negative:
            literal = {"true": True, "false": False, "null": None}[value.lower()]
        elif kind == "word":
            literal = _number(tokens, "-" * negative + value)
        else:
            raise tokens.fail(f"expected a value, found {value or 'the end'!r}")
        if edge and name.lower() == "weight":
            if isinstance(literal, bool) or not isinstance(literal, (int, float)):
                raise tokens.fail("a weight compares with a number")
            return Condition(("weight",), op, float(literal))
        return Condition(("prop", name), op, literal)


LANGUAGES: dict[str, Language] = {"simple": SimpleLanguage(), "cypher": PatternLanguage()}


def split_prefix(text: str, default: str = "simple") -> tuple[str, str]:
    """(language, query) of a text that may begin with simple: or cypher:"""
    for name in LANGUAGES:
        if text.startswith(f"{name}:"):
            return name, text[len(name) + 1 :].strip()
    return default, text.strip()


def language_switch(text: str) -> str | None:
    """The language that :lang x or :use x names."""
    m = re.fullmatch(r":(?:lang|use)\s+(\w+)", text.strip(), re.IGNORECASE)
    return m[1].lower() if m and m[1].lower() in LANGUAGES else None
