"""RDF terms as canonical N-Triples text.

A term is one string: ``<iri>``, ``_:label``, ``"lexical"``, ``"lexical"@lang`` or ``"lexical"^^<datatype>``; xsd:string is
left out. Equality of these strings is term identity, so joins, distinct and anti-joins need nothing else. The functions on
columns take a term apart where filters and bindings look inside.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
LANG_STRING = RDF + "langString"


class RuleError(ValueError):
    """A rule, term or run that is refused."""


_BAD_IRI = re.compile(r'[\x00-\x20<>"{}|^`\\]')
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
VARIABLE = re.compile(r"[?$]([a-zA-Z_][a-zA-Z0-9_]*)")
_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^>]*)>)?', re.S)
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_UNESCAPES = {v[1]: k for k, v in _ESCAPES.items()} | {"b": "\b", "f": "\f", "'": "'"}


def check_iri(value: str) -> str:
    """The IRI, if it is absolute and has no illegal character."""
    if m := _BAD_IRI.search(value):
        raise RuleError(f"illegal character {m[0]!r} in IRI {value!r}")
    if not _SCHEME.match(value):
        raise RuleError(f"IRI {value!r} has no scheme; only absolute IRIs are accepted")
    return value


def escape_literal(text: str) -> str:
    return "".join(_ESCAPES.get(c, c) for c in text)


def unescape_literal(text: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        return chr(int(x[1:], 16)) if x[0] in "uU" and len(x) > 1 else _UNESCAPES.get(x, x)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)


def iri(value: str) -> str:
    return f"<{check_iri(value)}>"


def literal(lexical: str, datatype: str | None = None, language: str | None = None) -> str:
    """Canonical text; a language wins over a datatype, xsd:string is the plain literal."""
    body = f'"{escape_literal(lexical)}"'
    if language:
        return f"{body}@{language}"
    return body if datatype in (None, "", XSD + "string") else f"{body}^^<{check_iri(datatype)}>"


@dataclass(frozen=True)
class Term:
    """A decoded term: kind is iri, bnode or literal."""

    kind: str
    value: str
    datatype: str | None = None
    language: str | None = None

    @property
    def text(self) -> str:
        return {"iri": lambda: iri(self.value), "bnode": lambda: f"_:{self.value}", "literal": lambda: literal(self.value, self.datatype, self.language)}[self.kind]()


def decode(text: str) -> Term:
    if text.startswith("<"):
        return Term("iri", text[1:-1])
    if text.startswith("_:"):
        return Term("bnode", text[2:])
    m = _LITERAL.fullmatch(text)
    if not m:
        raise RuleError(f"not a term: {text!r}")
    return Term("literal", unescape_literal(m[1]), m[3], m[2])


def from_json(cell: dict) -> str:
    """Canonical text of a term of the SPARQL JSON results format."""
    kind, value = cell.get("type"), cell.get("value", "")
    if kind == "uri":
        return iri(value)
    if kind == "bnode":
        return f"_:{value}"
    if kind in ("literal", "typed-literal"):
        return literal(value, cell.get("datatype"), cell.get("xml:lang"))
    raise RuleError(f"unknown term type {kind!r}")


def is_variable_text(text: str) -> bool:
    return bool(VARIABLE.fullmatch(text))


def variable_name(text: str) -> str:
    m = VARIABLE.fullmatch(text)
    if not m:
        raise RuleError(f"{text!r} is not a variable: ? or $, then a letter or _, then letters, digits or _")
    return m[1]


def encode_for_uri(text: str) -> str:
    return quote(text, safe="-._~")


# ---- on columns


def col_is_iri(t: Column) -> Column:
    return t.startswith("<")


def col_is_blank(t: Column) -> Column:
    return t.startswith("_:")


def col_is_literal(t: Column) -> Column:
    return t.startswith('"')


_TAIL = r'^"(?s:.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$'


def col_unescape(t: Column) -> Column:
    hold = F.lit("\x00")
    out = F.replace(t, F.lit("\\\\"), hold)
    for plain, escaped in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return F.when(t.contains("\\"), F.replace(out, hold, F.lit("\\"))).otherwise(t)


def col_escape(t: Column) -> Column:
    out = t
    for plain, escaped in _ESCAPES.items():
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def col_lexical(t: Column) -> Column:
    """The IRI or the lexical form; null for blank nodes."""
    return F.when(col_is_iri(t), F.substr(t, F.lit(2), F.length(t) - 2)).when(col_is_literal(t), col_unescape(F.regexp_extract(t, r'^"((?s:.*))"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)))


def col_language(t: Column) -> Column:
    return F.when(col_is_literal(t), F.regexp_extract(t, _TAIL, 1))


def col_datatype(t: Column) -> Column:
    """The datatype IRI of a literal; null for other terms."""
    found = F.regexp_extract(t, _TAIL, 2)
    return F.when(col_is_literal(t), F.when(found != "", found).when(F.regexp_extract(t, _TAIL, 1) != "", F.lit(LANG_STRING)).otherwise(F.lit(XSD + "string")))


def col_plain(text: Column) -> Column:
    return F.concat(F.lit('"'), col_escape(text), F.lit('"'))


def col_typed(text: Column, datatype: str) -> Column:
    return F.concat(F.lit('"'), col_escape(text), F.lit(f'"^^<{datatype}>'))


def col_iri(text: Column) -> Column:
    return F.concat(F.lit("<"), text, F.lit(">"))


def col_encode(text: Column) -> Column:
    """Percent-encoding of all but unreserved characters."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def decoded(quads):
    """Quads with o_kind (0 IRI, 1 blank node, 2 literal), o_lex, o_dt and o_lang beside the canonical text."""
    o = F.col("o")
    lang = col_language(o)
    dt = F.regexp_extract(o, _TAIL, 2)
    return quads.withColumns(
        {
            "o_kind": F.when(col_is_iri(o), 0).when(col_is_blank(o), 1).otherwise(2).cast("tinyint"),
            "o_lex": col_lexical(o),
            "o_dt": F.when(col_is_literal(o) & (dt != ""), dt),
            "o_lang": F.when(lang != "", lang),
        }
    )
