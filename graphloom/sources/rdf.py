"""Ontologies and graphs in RDF/XML and Turtle, as triples. A file is one task's work; files are read side by side."""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.mappings import parse_ntriples

TRIPLE = "s string, p string, o string, o_kind string, datatype string, lang string"
_RDF, _XML = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/XML/1998/namespace"
#: The datatypes of bare Turtle literals.
_XSD = "http://www.w3.org/2001/XMLSchema#"
Triple = tuple[str, str, str, str, str | None, str | None]


def _iri(name: str) -> str:
    space, _, local = name[1:].partition("}")
    return space + local if name.startswith("{") else name


class _Xml:
    """One document in the striped syntax: nodes hold properties, properties hold nodes."""

    def __init__(self, seed: str):
        self.seed, self.n, self.out = seed, 0, []

    def blank(self, name: str | None = None) -> str:
        self.n += name is None
        return f"_:{self.seed}{name if name is not None else f'n{self.n}'}"

    def put(self, s: str, p: str, o: str, kind: str = "iri", datatype: str | None = None, lang: str | None = None) -> None:
        self.out.append((s, p, o, kind, datatype, lang))

    def node(self, e: ET.Element, base: str, lang: str | None) -> str:
        base, lang = e.get(f"{{{_XML}}}base", base), e.get(f"{{{_XML}}}lang", lang)
        rdf = lambda x: e.get(f"{{{_RDF}}}{x}")
        if rdf("about") is not None:
            me = resolved(rdf("about"), base)
        elif rdf("ID") is not None:
            me = resolved("#" + rdf("ID"), base)
        else:
            me = self.blank(rdf("nodeID"))
        if _iri(e.tag) != _RDF + "Description":
            self.put(me, _RDF + "type", _iri(e.tag))
        for k, v in e.attrib.items():
            if not k.startswith((f"{{{_RDF}}}", f"{{{_XML}}}")) and k.startswith("{"):
                self.put(me, _iri(k), v, "lit", None, lang)
            elif k == f"{{{_RDF}}}type":
                self.put(me, _RDF + "type", resolved(v, base))
        listed = 0
        for p in e:
            listed += p.tag == f"{{{_RDF}}}li"
            self.property(me, p, f"{_RDF}_{listed}" if p.tag == f"{{{_RDF}}}li" else _iri(p.tag), base, lang)
        return me

    def property(self, me: str, e: ET.Element, name: str, base: str, lang: str | None) -> None:
        base, lang = e.get(f"{{{_XML}}}base", base), e.get(f"{{{_XML}}}lang", lang)
        rdf = lambda x: e.get(f"{{{_RDF}}}{x}")
        how = rdf("parseType")
        if rdf("resource") is not None:
            self.put(me, name, resolved(rdf("resource"), base))
        elif how == "Resource":
            b = self.blank()
            self.put(me, name, b)
            for p in e:
                self.property(b, p, _iri(p.tag), base, lang)
        elif how == "Collection":
            self.list(me, name, [self.node(x, base, lang) for x in e])
        elif how == "Literal":
            self.put(me, name, (e.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in e), "lit", _RDF + "XMLLiteral")
        elif len(e):
            for x in e:
                self.put(me, name, self.node(x, base, lang))
        elif rdf("nodeID") is not None:
            self.put(me, name, self.blank(rdf("nodeID")))
        else:
            self.put(me, name, e.text or "", "lit", rdf("datatype"), None if rdf("datatype") else lang)

    def list(self, me: str, name: str, items: list[str]) -> None:
        for x in items:
            b = self.blank()
            self.put(me, name, b)
            self.put(b, _RDF + "first", x)
            me, name = b, _RDF + "rest"
        self.put(me, name, _RDF + "nil")


def resolved(iri: str, base: str) -> str:
    """An IRI against a base."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) or not base:
        return iri
    if not iri:
        return base.partition("#")[0]
    if iri.startswith("#"):
        return base.partition("#")[0] + iri
    root = re.match(r"([^:]+://[^/]*)(.*)", base)
    if iri.startswith("/"):
        return (root[1] if root else "") + iri
    return base.partition("#")[0].rpartition("/")[0] + "/" + iri


def xml_triples(text: str, seed: str = "") -> list[Triple]:
    """The triples of an RDF/XML document."""
    root = ET.fromstring(text)
    x = _Xml(seed)
    base = root.get(f"{{{_XML}}}base", "")
    lang = root.get(f"{{{_XML}}}lang")
    for e in root if root.tag == f"{{{_RDF}}}RDF" else [root]:
        x.node(e, base, lang)
    return x.out


_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<kind>\^\^)|(?P<blank>_:[\w.-]*\w)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w:]))|(?P<name>[^\W\d]?[\w.-]*:(?:[\w:%-]|\.(?=[\w:%-])|\\.)*|[A-Za-z]+)|(?P<mark>[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPE = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _unescaped(text: str) -> str:
    one = lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPE.get(m[3], m[3])
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, text)


class _Turtle:
    """One Turtle document, read token by token."""

    def __init__(self, text: str, seed: str):
        self.tokens, self.i, self.seed, self.n = [], 0, seed, 0
        self.names: dict[str, str] = {}
        self.base, self.out = "", []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"no Turtle at {at}: {text[at : at + 40]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.i] if self.i < len(self.tokens) else ("end", "")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if mark is not None and t[1] != mark:
            raise ValueError(f"{mark} expected, {t[1]} found")
        self.i += 1
        return t

    def blank(self) -> str:
        self.n += 1
        return f"_:{self.seed}b{self.n}"

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            return resolved(_unescaped(text[1:-1]), self.base)
        prefix, _, local = text.partition(":")
        return self.names[prefix] + re.sub(r"\\(.)", r"\1", local)

    def document(self) -> list[Triple]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if text.lower() in ("@prefix", "prefix"):
                self.take()
                name = self.take()[1][:-1]
                self.names[name] = self.iri(*self.take())
                self.ended(text)
            elif text.lower() in ("@base", "base"):
                self.take()
                self.base = self.iri(*self.take())
                self.ended(text)
            else:
                s = self.term(True)[0]
                if self.peek()[1] != "." or kind != "mark":
                    self.properties(s)
                self.take(".")
        return self.out

    def ended(self, word: str) -> None:
        if word.startswith("@"):
            self.take(".")

    def properties(self, s: str) -> None:
        while True:
            kind, text = self.take()
            p = _RDF + "type" if text == "a" else self.iri(kind, text)
            while True:
                self.out.append((s, p, *self.term(False)))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]") or self.peek()[0] == "end" or self.tokens[self.i - 1][1] != ";":
                return

    def term(self, subject: bool) -> tuple[str, str, str | None, str | None]:
        kind, text = self.take()
        if text == "[":
            b = self.blank()
            if self.peek()[1] != "]":
                self.properties(b)
            self.take("]")
            return b, "iri", None, None
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term(False))
            self.take()
            nodes = [self.blank() for _ in items]
            for b, x, rest in zip(nodes, items, [*nodes[1:], _RDF + "nil"], strict=True):
                self.out += [(b, _RDF + "first", *x), (b, _RDF + "rest", rest, "iri", None, None)]
            return (nodes[0] if nodes else _RDF + "nil"), "iri", None, None
        if kind == "blank":
            return f"_:{self.seed}{text[2:]}", "iri", None, None
        if kind in ("text", "long"):
            value = _unescaped(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "at":
                return value, "lit", None, self.take()[1][1:]
            if self.peek()[0] == "kind":
                self.take()
                return value, "lit", self.iri(*self.take()), None
            return value, "lit", None, None
        if kind == "number":
            return text, "lit", _XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), None
        if text in ("true", "false"):
            return text, "lit", _XSD + "boolean", None
        return self.iri(kind, text), "iri", None, None


def turtle_triples(text: str, seed: str = "") -> list[Triple]:
    """The triples of a Turtle document."""
    return _Turtle(text, seed).document()


def parsed(files: DataFrame) -> DataFrame:
    """The triples of whole files by their suffix: .rdf, .owl and .xml are RDF/XML, all else Turtle. files: path, text. Blank nodes are told apart by their file."""

    def run(batches) -> Iterator:
        import pandas as pd

        for frame in batches:
            for path, text in zip(frame["path"], frame["text"], strict=True):
                seed = hashlib.md5(path.encode()).hexdigest()[:12] + "_"
                read = xml_triples if path.rpartition(".")[2].lower() in ("rdf", "owl", "xml") else turtle_triples
                yield pd.DataFrame(read(text, seed), columns=["s", "p", "o", "o_kind", "datatype", "lang"], dtype=object)

    return files.select("path", "text").mapInPandas(run, TRIPLE)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """The triples of a file or folder, by suffix; N-Triples (.nt) split and need no whole files."""
    if path.endswith(".nt"):
        return parse_ntriples(spark.read.text(path))
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.nt").text(path).select("value") if not re.search(r"\.\w+$", path) else None
    out = [parsed(whole.where("path not like '%.nt'"))] + ([parse_ntriples(lines)] if lines is not None else [])
    return reduce(DataFrame.unionByName, out)


def turtle_lines(t: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """A Turtle statement for each subject, its predicates sorted, names shortened by the prefixes; the prefixes are lines of their own, first by `n`. Columns n, line."""

    def short(c):
        out = F.concat(F.lit("<"), c, F.lit(">"))
        for k, v in prefixes.items():
            local = F.substr(c, F.lit(len(v) + 1))
            out = F.when(c.startswith(v) & local.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(F.lit(k + ":"), local)).otherwise(out)
        return F.when(c.startswith("_:"), c).otherwise(out)

    text = F.col("o")
    for char, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(char), F.lit(written))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.when(F.col("datatype").isNotNull(), F.concat(F.lit("^^"), short(F.col("datatype")))).when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).otherwise(F.lit("")))
    one = F.concat_ws(" ", short(F.col("p")), F.when(F.col("o_kind") == "iri", short(F.col("o"))).otherwise(literal))
    body = t.groupBy("s").agg(F.array_join(F.array_sort(F.collect_set(one)), " ;\n    ").alias("b")).select(F.lit(1).alias("n"), F.concat(short(F.col("s")), F.lit(" "), "b", F.lit(" .")).alias("line"))
    head = t.sparkSession.createDataFrame([(0, f"@prefix {k}: <{v}> .") for k, v in prefixes.items()] or [(0, "")], "n int, line string")
    return head.unionByName(body)
