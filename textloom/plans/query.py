"""The boolean query language: lexer, parser, and compilation into column predicates.

``or := and ('||' and)*``, ``and := not (('&&')? not)*``, ``not := '!' not | term | '(' or ')'``.
Queries are read as far as they make sense: a missing parenthesis, operand or a lone ``&`` or ``|``
is no error.

There is no universe of documents: a negation removes from what stands beside it in a conjunction
and matches nothing anywhere else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.porter import stem
from textloom.functions.text import ascii_lower_py

_LEX = re.compile(r"\(|\)|!|&&|\|\||[^ \t\n\r()!&|]+")


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class Not:
    operand: Node


Node = Term | And | Or | Not | None


def parse(query: str | None) -> Node:
    """Syntax tree of a query; nothing for a query without an operand to begin with."""
    tokens = _LEX.findall(query or "")
    tokens.reverse()

    def at(*kinds: str) -> bool:
        return bool(tokens) and tokens[-1] in kinds

    def either() -> Node:
        node = both()
        while at("||"):
            tokens.pop()
            node = Or(node, both())
        return node

    def both() -> Node:
        node = negation()
        while tokens and not at("||", ")"):
            if at("&&"):
                tokens.pop()
            node = And(node, negation())
        return node

    def negation() -> Node:
        depth = 0
        while at("!"):
            tokens.pop()
            depth += 1
        if at("("):
            tokens.pop()
            node = either()
            if at(")"):
                tokens.pop()
        elif not tokens or at(")", "&&", "||"):
            node = None
        else:
            node = Term(tokens.pop())
        for _ in range(depth):
            node = Not(node)
        return node

    return either()


def normalize(term: str, stemming: bool = True) -> str:
    low = ascii_lower_py(term)
    return stem(low) if stemming else low


def terms(node: Node, positive_only: bool = False, stemming: bool = True) -> list[str]:
    """Normalised terms in the order they are first met; ``positive_only`` leaves out negations."""
    found: dict[str, None] = {}

    def walk(n: Node) -> None:
        match n:
            case Term(text):
                found.setdefault(normalize(text, stemming))
            case Not(operand) if not positive_only:
                walk(operand)
            case And(left, right) | Or(left, right):
                walk(left)
                walk(right)

    walk(node)
    return list(found)


def evaluate(node: Node, combine):
    """Folds a tree with ``combine(kind, *operands)``: ``term``, ``and``, ``or``, ``minus``, ``none``.
    The one place where the rules for negations are written down."""
    match node:
        case Term(text):
            return combine("term", text)
        case And(Not(), Not()):
            return combine("none")
        case And(Not(operand), other) | And(other, Not(operand)):
            return combine("minus", evaluate(other, combine), evaluate(operand, combine))
        case And(left, right):
            return combine("and", evaluate(left, combine), evaluate(right, combine))
        case Or(left, right):
            return combine("or", evaluate(left, combine), evaluate(right, combine))
    return combine("none")


def predicate(node: Node, has: dict[str, Column], stemming: bool = True) -> Column:
    """Predicate over columns that say whether a document has a term."""

    def combine(kind: str, *x):
        match kind:
            case "term":
                return has[normalize(x[0], stemming)]
            case "and":
                return x[0] & x[1]
            case "or":
                return x[0] | x[1]
            case "minus":
                return x[0] & ~x[1]
        return F.lit(False)

    return evaluate(node, combine)


def matches(node: Node, postings: dict[str, set], stemming: bool = True) -> set:
    """Matching documents by sets: the plain meaning, for tests."""

    def combine(kind: str, *x):
        match kind:
            case "term":
                return postings.get(normalize(x[0], stemming), set())
            case "and":
                return x[0] & x[1]
            case "or":
                return x[0] | x[1]
            case "minus":
                return x[0] - x[1]
        return set()

    return evaluate(node, combine)
