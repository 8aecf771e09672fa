"""Class expressions in functional syntax: a parse tree with places, and their reading in plain words.

There is no part-of-speech tagger here: a property gets "is" before it if its first word ends in "ed" or is in the caller's list of
nouns and adjectives. An expression that doesn't parse gives null.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<op>\w+)\s*\(|(?P<iri><[^>]*>)|(?P<end>\)))")
_RESTRICTION = {"ObjectSomeValuesFrom": "some", "ObjectAllValuesFrom": "only"}
_JUNCTION = {"ObjectIntersectionOf": "and", "ObjectUnionOf": "or"}
_AXIOM = {"SubClassOf": "is a kind of", "EquivalentClasses": "is the same as", "SuperClassOf": "includes"}


class Node(NamedTuple):
    name: str
    start: int
    end: int
    children: tuple[Node, ...]


def parse(text: str) -> Node:
    """The tree of an expression; every node knows its place in the text."""
    open_: list[tuple[str, int, list[Node]]] = [("", 0, [])]
    at = 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no expression at {at}")
        at = m.end()
        if m["op"]:
            open_.append((m["op"], m.start("op"), []))
        elif m["iri"]:
            open_[-1][2].append(Node(m["iri"][1:-1], m.start("iri"), m.end(), ()))
        elif len(open_) == 1:
            raise ValueError(f"nothing to close at {at}")
        else:
            name, start, kids = open_.pop()
            open_[-1][2].append(Node(name, start, at, tuple(kids)))
    if len(open_) != 1 or len(open_[0][2]) != 1:
        raise ValueError("not one whole expression")
    return open_[0][2][0]


def nodes(root: Node):
    """(depth, node) from the root on, in the text's order."""
    todo = [(0, root)]
    while todo:
        depth, n = todo.pop()
        yield depth, n
        todo += [(depth + 1, c) for c in reversed(n.children)]


def verbal(n: Node, names: Mapping[str, str], is_words: Collection[str] = ()) -> str:
    """Restrictions of one property are joined; bare classes come before restrictions."""

    def verb(p: Node) -> str:
        name = names.get(p.name, p.name)
        first = name.split(" ")[0]
        return f"is {name}" if first.endswith("ed") or first in is_words else name

    def restriction(r: Node) -> tuple[str, str]:
        prop, filler = r.children
        return f"{verb(prop)} {_RESTRICTION[r.name]}", verbal(filler, names, is_words)

    if n.name in _RESTRICTION:
        return "something that {} {}".format(*restriction(n))
    if n.name == "ObjectComplementOf":
        return f"not {verbal(n.children[0], names, is_words)}"
    if n.name in _JUNCTION:
        word = f" {_JUNCTION[n.name]} "
        plain = word.join(verbal(c, names, is_words) for c in n.children if c.name not in _RESTRICTION)
        by_property: dict[str, list[str]] = {}
        for kind in _RESTRICTION:
            for c in n.children:
                if c.name == kind:
                    start, filler = restriction(c)
                    by_property.setdefault(start, []).append(filler)
        rest = word.join(f"{start} {word.join(fillers)}" for start, fillers in by_property.items())
        if not rest:
            return plain
        if not plain:
            return f"something that {rest}"
        return f"{plain} that {rest}" if n.name == "ObjectIntersectionOf" else f"{plain} or something that {rest}"
    if n.name in _AXIOM:
        a, b = n.children
        return f"{verbal(a, names, is_words)} {_AXIOM[n.name]} {verbal(b, names, is_words)}"
    if n.children:
        raise ValueError(f"unknown operator {n.name}")
    return names.get(n.name, n.name)


def verbalised(expression: Column, names: Column, is_words: Collection[str] = ()) -> Column:
    """names: map<string, string> of the entities in the row's own expression, so that no vocabulary is broadcast."""

    def one(text: str | None, known) -> str | None:
        try:
            return verbal(parse(text or ""), dict(known if known is not None else {}), is_words)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([one(t, k) for t, k in zip(texts, known, strict=True)], dtype=object)

    return run(expression, names)


def entities(expression: Column) -> Column:
    """The different IRIs of an expression."""
    return F.array_distinct(F.regexp_extract_all(expression, F.lit("<([^>]*)>"), F.lit(1)))
