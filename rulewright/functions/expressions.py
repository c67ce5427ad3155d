"""SPARQL expressions as Spark columns.

A text is tokenised, parsed by precedence, and compiled to columns that are null where SPARQL has an error or an unbound
value: null in a filter drops the row, in a binding it leaves the variable unbound. Comparison is by value: numbers as decimals
(as doubles where they are too large for that), times with times and dates with dates, booleans, plain strings; other terms by
identity, and null where two values can't be compared. Functions of strings keep the language tag of what they take a part of;
parts of dates are read from the lexical form, in its own time zone.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms as T
from .terms import RuleError

DECIMAL = "decimal(38,18)"
_INTEGERS = tuple(T.XSD + n for n in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte"))
_DECIMALS = (T.XSD + "decimal", T.XSD + "double", T.XSD + "float")
NUMERIC = _INTEGERS + _DECIMALS
_TIME, _DATE = T.XSD + "dateTime", T.XSD + "date"
_ZONE = r"(Z|[+-]\d\d:\d\d)?"
_DATE_TEXT = r"^(-?\d{4,})-(\d\d)-(\d\d)"
_TIME_TEXT = _DATE_TEXT + r"T(\d\d):(\d\d):(\d\d(?:\.\d+)?)" + _ZONE + "$"
#: Lexical forms that casts from strings accept.
_INTEGER_TEXT, _DECIMAL_TEXT, _DOUBLE_TEXT = r"^[+-]?\d+$", r"^[+-]?(\d+(\.\d*)?|\.\d+)$", r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"

_TOKEN = re.compile(
    r"""\s*(?:(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<var>[?$]\w+)|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')(?:@(?P<lang>[A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^(?P<dt><[^>]*>))?"""
    r"""|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?|\.\d+)|(?P<op>\|\||&&|!=|<=|>=|[=<>!+*/(),-])|(?P<name>[A-Za-z_]\w*))"""
)


def skeleton(text: str) -> str:
    """The text with string literals and IRIs blanked; refuses a literal left open."""
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if c in "\"'":
            m = re.compile(rf"{c}(?:[^{c}\\\n]|\\.)*{c}").match(text, at)
            if not m:
                raise RuleError(f"expression {text!r} has an open literal")
            out.append('""')
            at = m.end()
        elif c == "<" and (m := re.compile(r'<[A-Za-z][^<>"{}|^`\\\s]*>').match(text, at)):
            out.append("<>")
            at = m.end()
        else:
            out.append(c)
            at += 1
    return "".join(out)


def check_text(text: str) -> set[str]:
    """The variables an expression reads; refuses what is no single expression."""
    if not text.strip():
        raise RuleError("an expression is empty")
    bare = skeleton(text)
    if m := re.search(r"[{}#;]", bare):
        raise RuleError(f"expression {text!r} contains {m[0]!r}")
    if re.search(r"(?i)^\s*(FILTER|BIND|OPTIONAL|SELECT|VALUES|GRAPH|SERVICE|MINUS|UNION)\b", bare):
        raise RuleError(f"expression {text!r} is a whole clause; give the expression alone")
    if re.search(r"(?i)\bAS\s+[?$]", bare):
        raise RuleError(f"expression {text!r} contains AS; name the variable in the declaration")
    if m := re.search(r"[A-Za-z_][\w-]*:[A-Za-z_]\w*|(?<![\w:]):[A-Za-z_]\w*", bare):
        raise RuleError(f"expression {text!r} uses the prefixed name {m[0]!r}; write the IRI in full")
    depth = 0
    for c in bare:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            break
    if depth:
        raise RuleError(f"expression {text!r} has unbalanced parentheses")
    return {v[1:] for v in re.findall(r"[?$]\w+", bare)}


def tokens(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise RuleError(f"expression {text!r} can't be read at {text[at:][:20]!r}")
        kind = m.lastgroup
        if m["str"] is not None:
            out.append(("term", T.literal(T.unescape_literal(m["str"][1:-1]), m["dt"][1:-1] if m["dt"] else None, m["lang"])))
        elif kind == "iri":
            out.append(("term", T.iri(m["iri"][1:-1])))
        elif kind == "num":
            x = m["num"]
            dt = "double" if "e" in x.lower() else "decimal" if "." in x else "integer"
            out.append(("term", T.literal(x, T.XSD + dt)))
        elif kind == "var":
            out.append(("var", m["var"][1:]))
        elif kind == "name":
            out.append(("name", m["name"]))
        else:
            out.append(("op", m["op"]))
        at = m.end()
    return out


# ---- syntax trees: ("term", text) ("var", name) ("call", NAME or iri, args) ("op", symbol, args)

_LEVELS = (("||",), ("&&",), ("=", "!=", "<", ">", "<=", ">=", "IN"), ("+", "-"), ("*", "/"))


def parse(text: str) -> tuple:
    check_text(text)
    toks, at = tokens(text), 0

    def peek(k: int = 0) -> tuple[str, object]:
        return toks[at + k] if at + k < len(toks) else ("end", None)

    def take(kind: str | None = None, value: object = None) -> tuple[str, object]:
        nonlocal at
        t = peek()
        if (kind and t[0] != kind) or (value is not None and t[1] != value):
            raise RuleError(f"expression {text!r}: expected {value or kind}, found {t[1]!r}")
        at += 1
        return t

    def arguments() -> list[tuple]:
        take("op", "(")
        args = []
        while peek() != ("op", ")"):
            if args:
                take("op", ",")
            args.append(level(0))
        take("op", ")")
        return args

    def level(k: int) -> tuple:
        if k == len(_LEVELS):
            return unary()
        left = level(k + 1)
        while True:
            kind, v = peek()
            if kind == "op" and v in _LEVELS[k]:
                take()
                left = ("op", v, [left, level(k + 1)])
            elif k == 2 and kind == "name" and str(v).upper() in ("IN", "NOT"):
                take()
                negated = str(v).upper() == "NOT"
                if negated and str(take("name")[1]).upper() != "IN":
                    raise RuleError(f"expression {text!r}: NOT must be followed by IN")
                left = ("op", "NOT IN" if negated else "IN", [left, *arguments()])
            else:
                return left

    def unary() -> tuple:
        kind, v = peek()
        if kind == "op" and v in ("!", "-", "+"):
            take()
            return ("op", f"unary{v}", [unary()])
        if kind == "op" and v == "(":
            take()
            inner = level(0)
            take("op", ")")
            return inner
        if kind == "var":
            return take()
        if kind == "term":
            take()
            return ("call", v, arguments()) if str(v).startswith("<") and peek() == ("op", "(") else ("term", v)
        if kind == "name":
            take()
            if str(v).lower() in ("true", "false"):
                return ("term", T.literal(str(v).lower(), T.XSD + "boolean"))
            return ("call", str(v).upper(), arguments())
        raise RuleError(f"expression {text!r} ends too soon or has {v!r} out of place")

    tree = level(0)
    if peek()[0] != "end":
        raise RuleError(f"expression {text!r} goes on after its end: {peek()[1]!r}")
    return tree


# ---- values


@dataclass(frozen=True)
class Value:
    """kind: term (canonical text, any type), str, num or bool. ``whole``: a number that is an integer; ``big``: a number as a
    double, where it may be too large for the decimal; ``lang``: the language tag of a string, empty or none at all if it has none."""

    kind: str
    col: Column
    whole: Column | None = None
    big: Column | None = None
    lang: Column | None = None


def null() -> Column:
    return F.lit(None).cast("string")


def decimal_text(x: Column) -> Column:
    """The shortest plain notation of a decimal."""
    s = x.cast("string")
    return F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)


def _family(t: Column) -> Column:
    dt = T.col_datatype(t)
    return (
        F.when(~T.col_is_literal(t), F.lit("node"))
        .when(dt.isin(*NUMERIC), F.lit("num"))
        .when(dt == _TIME, F.lit("time"))
        .when(dt == _DATE, F.lit("date"))
        .when(dt == T.XSD + "boolean", F.lit("bool"))
        .when(dt == T.XSD + "string", F.lit("str"))
        .otherwise(F.lit("other"))
    )


def number(v: Value) -> tuple[Column, Column]:
    """(decimal, whether an integer)."""
    if v.kind == "num":
        return v.col, v.whole
    if v.kind == "term":
        dt, lex = T.col_datatype(v.col), T.col_lexical(v.col)
        x = F.when(dt.isin(*_INTEGERS, T.XSD + "decimal"), lex.try_cast(DECIMAL)).when(dt.isin(*_DECIMALS), lex.try_cast("double").try_cast(DECIMAL))
        return x, dt.isin(*_INTEGERS)
    return F.lit(None).cast(DECIMAL), F.lit(None).cast("boolean")


def string(v: Value, any_term: bool = False) -> Column:
    """The text of a string; of any term but a blank node, if asked (STR)."""
    if v.kind == "str":
        return v.col
    if v.kind == "term":
        if any_term:
            return T.col_lexical(v.col)
        dt = T.col_datatype(v.col)
        return F.when(dt.isin(T.XSD + "string", T.LANG_STRING), T.col_lexical(v.col))
    if any_term:
        return T.col_lexical(as_term(v))
    return null()


def boolean(v: Value) -> Column:
    """The effective boolean value."""
    if v.kind == "bool":
        return v.col
    if v.kind == "num":
        return v.col != 0
    if v.kind == "str":
        return v.col != ""
    if v.kind == "term":
        f, lex = _family(v.col), T.col_lexical(v.col)
        return F.when(f == "bool", F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False)).when(f == "num", F.coalesce(number(v)[0] != 0, F.lit(False))).when(f == "str", lex != "")
    return F.lit(None).cast("boolean")


def double(v: Value) -> Column:
    if v.kind == "num":
        return v.col.cast("double") if v.big is None else v.big
    if v.kind == "term":
        return F.when(T.col_datatype(v.col).isin(*NUMERIC), T.col_lexical(v.col).try_cast("double"))
    return F.lit(None).cast("double")


def time(v: Value, datatype: str = _TIME) -> Column:
    """The instant of a dateTime, or of a date's beginning."""
    if v.kind == "term":
        return F.when(T.col_datatype(v.col) == datatype, T.col_lexical(v.col).try_cast("timestamp"))
    return F.lit(None).cast("timestamp")


def tag(v: Value) -> Column | None:
    """The language tag, empty if it has none; None where it can't have any."""
    return T.col_language(v.col) if v.kind == "term" else v.lang


def tagged(x: Column, like: Value) -> Value:
    """A string with the language tag of another."""
    return Value("str", x, lang=tag(like))


def language(v: Value) -> Column:
    lang = tag(v)
    return F.lit("") if lang is None else F.lower(lang)


def compatible(a: Value, b: Value) -> Column:
    """Whether b can be looked for in a: it has no tag, or the same."""
    if tag(b) is None:
        return F.lit(True)
    return (language(b) == "") | (language(a) == language(b))


def as_term(v: Value) -> Column:
    """Canonical text."""
    if v.kind == "term":
        return v.col
    if v.kind == "str":
        plain = T.col_plain(v.col)
        return plain if v.lang is None else F.when(v.lang == "", plain).otherwise(F.concat(plain, F.lit("@"), v.lang))
    if v.kind == "bool":
        return T.col_typed(v.col.cast("string"), T.XSD + "boolean")
    text = decimal_text(v.col)
    if v.big is not None:
        return F.when(v.col.isNull(), T.col_typed(v.big.cast("string"), T.XSD + "double")).when(v.whole, T.col_typed(text, T.XSD + "integer")).otherwise(T.col_typed(text, T.XSD + "decimal"))
    return F.when(v.whole, T.col_typed(text, T.XSD + "integer")).otherwise(T.col_typed(text, T.XSD + "decimal"))


def _kind(v: Value) -> Column:
    if v.kind == "str" and v.lang is not None:
        return F.when(v.lang == "", F.lit("str")).otherwise(F.lit("other"))
    return _family(v.col) if v.kind == "term" else F.lit(v.kind)


def compare(op: str, a: Value, b: Value) -> Column:
    ops: dict[str, Callable[[Column, Column], Column]] = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
    f = ops[op]
    ka, kb = _kind(a), _kind(b)
    both = lambda k: (ka == k) & (kb == k)
    out = F.when(both("num"), F.coalesce(f(number(a)[0], number(b)[0]), f(double(a), double(b)))).when(both("str"), f(string(a), string(b)))
    out = out.when(both("time"), f(time(a), time(b))).when(both("date"), f(time(a, _DATE), time(b, _DATE))).when(both("bool"), f(boolean(a), boolean(b)))
    if op in ("=", "!="):
        ta, tb = as_term(a), as_term(b)
        out = out.when((ka == "node") | (kb == "node"), f(ta, tb)).when(ta == tb, F.lit(op == "="))
        out = out.when((T.col_language(ta) != "") & (T.col_language(tb) != ""), f(ta, tb))
    return out


def arithmetic(op: str, a: Value, b: Value) -> Value:
    (x, xi), (y, yi) = number(a), number(b)
    f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
    return Value("num", f(x, y).try_cast(DECIMAL), F.lit(False) if op == "/" else xi & yi, f(double(a), double(b)))


#: Refused by name: they give another value every time, so that an Assert rule would never come to rest.
UNSTABLE = ("RAND", "NOW", "UUID", "STRUUID", "BNODE")
_ARITY = {
    "STR": 1, "DATATYPE": 1, "LANG": 1, "IRI": 1, "URI": 1, "BOUND": 1, "IF": 3, "STRSTARTS": 2, "STRENDS": 2, "CONTAINS": 2, "STRBEFORE": 2, "STRAFTER": 2,
    "UCASE": 1, "LCASE": 1, "STRLEN": 1, "MD5": 1, "SHA1": 1, "SHA256": 1, "SHA384": 1, "SHA512": 1, "ROUND": 1, "ABS": 1, "CEIL": 1, "FLOOR": 1, "ENCODE_FOR_URI": 1,
    "ISIRI": 1, "ISURI": 1, "ISBLANK": 1, "ISLITERAL": 1, "ISNUMERIC": 1, "SAMETERM": 2, "STRDT": 2, "STRLANG": 2, "LANGMATCHES": 2,
    "YEAR": 1, "MONTH": 1, "DAY": 1, "HOURS": 1, "MINUTES": 1, "SECONDS": 1, "TZ": 1,
}


#: Groups of the lexical form of a dateTime.
_PARTS = {"YEAR": 1, "MONTH": 2, "DAY": 3, "HOURS": 4, "MINUTES": 5, "SECONDS": 6}


def build(tree: tuple, columns: dict[str, Column]) -> Value:
    kind = tree[0]
    if kind == "term":
        return Value("term", F.lit(tree[1]))
    if kind == "var":
        return Value("term", columns.get(tree[1], null()))
    args = tree[2]
    if kind == "op":
        op = tree[1]
        if op in ("||", "&&"):
            x, y = (boolean(build(a, columns)) for a in args)
            return Value("bool", x | y if op == "||" else x & y)
        if op == "unary!":
            return Value("bool", ~boolean(build(args[0], columns)))
        if op in ("unary-", "unary+"):
            x, whole = number(build(args[0], columns))
            return Value("num", -x if op == "unary-" else x, whole)
        if op in ("IN", "NOT IN"):
            first, *rest = (build(a, columns) for a in args)
            hit = F.lit(False)
            for r in rest:
                hit = hit | compare("=", first, r)
            return Value("bool", hit if op == "IN" else ~hit)
        a, b = (build(x, columns) for x in args)
        return arithmetic(op, a, b) if op in ("+", "-", "*", "/") else Value("bool", compare(op, a, b))
    return call(tree[1], args, columns)


def call(name: str, trees: list[tuple], columns: dict[str, Column]) -> Value:
    if name in UNSTABLE:
        raise RuleError(f"{name} gives another value every time and is refused")
    if name in _ARITY and len(trees) != _ARITY[name]:
        raise RuleError(f"{name} takes {_ARITY[name]} argument(s), not {len(trees)}")
    if name == "BOUND":
        if trees[0][0] != "var":
            raise RuleError("BOUND takes a variable")
        return Value("bool", columns.get(trees[0][1], null()).isNotNull())
    v = [build(t, columns) for t in trees]
    text = lambda i: string(v[i])
    if name.startswith("<"):
        return cast(name[1:-1], v)
    one = {
        "UCASE": lambda s: F.upper(s), "LCASE": lambda s: F.lower(s), "MD5": lambda s: F.md5(s), "SHA1": lambda s: F.sha1(s), "SHA256": lambda s: F.sha2(s, 256), "SHA384": lambda s: F.sha2(s, 384),
        "SHA512": lambda s: F.sha2(s, 512), "ENCODE_FOR_URI": T.col_encode,
    }
    if name in one:
        return tagged(one[name](text(0)), v[0]) if name in ("UCASE", "LCASE") else Value("str", one[name](text(0)))
    if name == "STR":
        return Value("str", string(v[0], any_term=True))
    if name == "DATATYPE":
        return Value("term", T.col_iri(T.col_datatype(as_term(v[0]))))
    if name == "LANG":
        return Value("str", T.col_language(as_term(v[0])) if v[0].kind != "str" or v[0].lang is None else v[0].lang)
    if name in ("IRI", "URI"):
        t = as_term(v[0])
        return Value("term", F.when(T.col_is_iri(t), t).otherwise(T.col_iri(string(v[0]))))
    if name == "CONCAT":
        whole = F.concat(*(string(x) for x in v)) if v else F.lit("")
        if not v or any(tag(x) is None for x in v):  # one without a tag: the whole has none
            return Value("str", whole)
        same = reduce(lambda x, y: x & y, (language(x) == language(v[0]) for x in v))
        return Value("str", whole, lang=F.when(same, tag(v[0])).otherwise(F.lit("")))
    if name == "IF":
        c = boolean(v[0])
        if v[1].kind == v[2].kind and v[1].kind in ("str", "bool"):
            langs = [tag(x) for x in v[1:]]
            lang = None if langs[0] is None and langs[1] is None else F.when(c, F.lit("") if langs[0] is None else langs[0]).otherwise(F.lit("") if langs[1] is None else langs[1])
            return Value(v[1].kind, F.when(c, v[1].col).when(~c, v[2].col), lang=lang)
        return Value("term", F.when(c, as_term(v[1])).when(~c, as_term(v[2])))
    if name == "COALESCE":
        return Value("term", F.coalesce(*(as_term(x) for x in v)))
    if name in ("STRSTARTS", "STRENDS", "CONTAINS"):
        return Value("bool", F.when(compatible(v[0], v[1]), {"STRSTARTS": F.startswith, "STRENDS": F.endswith, "CONTAINS": F.contains}[name](text(0), text(1))))
    if name in ("STRBEFORE", "STRAFTER"):
        x, y = text(0), text(1)
        at = F.when(compatible(v[0], v[1]), F.instr(x, y))
        cut = F.substr(x, F.lit(1), at - 1) if name == "STRBEFORE" else F.substr(x, at + F.length(y))
        lang = tag(v[0])
        return Value("str", F.when(at > 0, cut).when(at == 0, F.lit("")), lang=None if lang is None else F.when(at > 0, lang).otherwise(F.lit("")))
    if name in ("REPLACE", "REGEX"):
        return regex(name, trees, v)
    if name == "STRLEN":
        return Value("num", F.length(text(0)).cast(DECIMAL), F.lit(True))
    if name == "SUBSTR":
        at = number(v[1])[0].cast("int")
        return tagged(F.substr(text(0), at, number(v[2])[0].cast("int")) if len(v) > 2 else F.substr(text(0), at), v[0])
    if name in ("ROUND", "ABS", "CEIL", "FLOOR"):
        x, whole = number(v[0])
        y = {"ROUND": lambda c: F.floor(c + F.lit(0.5).cast("decimal(2,1)")), "ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor}[name](x)
        return Value("num", y.try_cast(DECIMAL), whole)
    if name in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL"):
        return Value("bool", {"ISBLANK": T.col_is_blank, "ISLITERAL": T.col_is_literal}.get(name, T.col_is_iri)(as_term(v[0])))
    if name == "ISNUMERIC":
        t = as_term(v[0])
        return Value("bool", F.when(t.isNotNull(), number(Value("term", t))[0].isNotNull()))
    if name == "SAMETERM":
        return Value("bool", as_term(v[0]) == as_term(v[1]))
    if name == "STRDT":
        return Value("term", F.concat(F.lit('"'), T.col_escape(text(0)), F.lit('"^^'), as_term(v[1])))
    if name == "STRLANG":
        return Value("term", F.concat(F.lit('"'), T.col_escape(text(0)), F.lit('"@'), text(1)))
    if name == "LANGMATCHES":
        a, b = F.lower(text(0)), F.lower(text(1))
        return Value("bool", F.when(b == "*", a != "").otherwise((a == b) | F.startswith(a, F.concat(b, F.lit("-")))))
    if name in _PARTS:
        t = as_term(v[0])
        lex, dt = T.col_lexical(t), T.col_datatype(t)
        told = F.when(dt == _TIME, F.regexp_extract(lex, _TIME_TEXT, _PARTS[name]))
        if _PARTS[name] <= 3:
            told = told.when(dt == _DATE, F.regexp_extract(lex, _DATE_TEXT + _ZONE + "$", _PARTS[name]))
        return Value("num", told.try_cast(DECIMAL), F.lit(name != "SECONDS"))
    if name == "TZ":
        t = as_term(v[0])
        return Value("str", F.when((T.col_datatype(t) == _TIME) & T.col_lexical(t).rlike(_TIME_TEXT), F.regexp_extract(T.col_lexical(t), _TIME_TEXT, 7)))
    raise RuleError(f"unknown function {name}")


def regex(name: str, trees: list[tuple], v: list[Value]) -> Value:
    n = 3 if name == "REPLACE" else 2
    if len(v) not in (n, n + 1):
        raise RuleError(f"{name} takes {n} or {n + 1} arguments, not {len(v)}")
    pattern = string(v[1])
    if len(v) == n + 1:
        pattern = F.concat(F.lit("(?"), string(v[n]), F.lit(")"), pattern)
    if name == "REGEX":
        return Value("bool", F.rlike(string(v[0]), pattern))
    return tagged(F.regexp_replace(string(v[0]), pattern, string(v[2])), v[0])


def cast(datatype: str, v: list[Value]) -> Value:
    if len(v) != 1:
        raise RuleError(f"a cast takes one argument, not {len(v)}")
    x = v[0]
    lex, family = string(x, any_term=True), _kind(x)
    flag = boolean(x).cast("int").cast(DECIMAL)

    def numeric(form: str) -> Column:
        """Of a string in that form, of a number or of a boolean."""
        read = lex.try_cast(DECIMAL) if form != _DOUBLE_TEXT else F.coalesce(lex.try_cast(DECIMAL), lex.try_cast("double").try_cast(DECIMAL))
        return F.when(family == "num", number(x)[0]).when(family == "bool", flag).when((family == "str") & lex.rlike(form), read)

    if datatype == T.XSD + "string":
        return Value("str", lex)
    if datatype in _INTEGERS:
        n = numeric(_INTEGER_TEXT)
        return Value("num", (F.signum(n) * F.floor(F.abs(n))).try_cast(DECIMAL), F.lit(True))
    if datatype in _DECIMALS:
        return Value("num", numeric(_DECIMAL_TEXT if datatype == T.XSD + "decimal" else _DOUBLE_TEXT), F.lit(False))
    if datatype == T.XSD + "boolean":
        return Value("bool", F.when(family == "num", number(x)[0] != 0).when(family == "bool", boolean(x)).when((family == "str") & lex.isin("true", "1"), True).when((family == "str") & lex.isin("false", "0"), False))
    if datatype == _TIME:
        text = F.when((family.isin("time", "str")) & lex.rlike(_TIME_TEXT), lex).when(family == "date", F.regexp_replace(lex, _DATE_TEXT, "$1-$2-$3T00:00:00"))
        return Value("term", F.when(text.try_cast("timestamp").isNotNull(), T.col_typed(text, _TIME)))
    if datatype == _DATE:
        text = F.when((family.isin("date", "str")) & lex.rlike(_DATE_TEXT + _ZONE + "$"), lex).when(family == "time", F.regexp_replace(lex, r"T\d\d:\d\d:\d\d(\.\d+)?", ""))
        return Value("term", F.when(F.regexp_extract(text, r"^-?\d{4,}-\d\d-\d\d", 0).try_cast("date").isNotNull(), T.col_typed(text, _DATE)))
    raise RuleError(f"no cast to {datatype}")


def filter_column(text: str, columns: dict[str, Column]) -> Column:
    return boolean(build(parse(text), columns))


def binding_column(text: str, columns: dict[str, Column]) -> Column:
    return as_term(build(parse(text), columns))
