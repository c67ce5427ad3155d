"""Personal data by anchor expansion.

An Aho-Corasick automaton walks each text once and reports anchors: at-signs, plus signs, digits, URL schemes and cues of
identifiers. Around an anchor a parser of that kind expands to the left and the right, validates (numeric ranges, Luhn
checksum, digit counts) and fixes the boundaries. The parsers of base kinds give what a leftmost, non-overlapping scan with
the kind's pattern gives; a match that fails validation uses up its text.

Beyond the base kinds: ``url`` is a URL that carries user information (``scheme://user:password@host``), ``account`` the
number that follows an identifier cue (IBAN, account, SSN, passport, tax number), eight or more characters with five digits
or more (an IBAN must pass its checksum). The number grows group by group, with one space or hyphen between, to the end of
the longest run of groups that is valid.

Defined results: null texts count as empty; empty texts have no spans; each row of repeated rows is answered; offsets are
code points, ends exclusive; spans of different kinds may overlap; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = 4
CUES = ("iban", "account", "acct", "ssn", "passport", "tax id", "konto", "compte", "cuenta")
SCHEMES = ("://",)

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ASCII_DIGIT = re.compile(r"[0-9]")
URL_REST = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+(?::[^\s/@]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
CUE_REST = re.compile(r"(?:\s?(?:no|nr|number|num)\b\.?)?\s?[:#=]?\s?", re.I)
ACCOUNT_START = re.compile(r"[A-Za-z]{0,4}[0-9]")
GROUP = re.compile(r"([ -]?)([A-Za-z0-9]{1,64})(?![A-Za-z0-9])")
#: Characters of an IBAN, by country.
IBAN_LENGTH = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def iban(s: str) -> bool:
    s = re.sub(r"[ -]", "", s).upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_end(text: str, start: int) -> int:
    """Where the IBAN that starts there ends, or -1: at its country's length, else at the longest run of groups that passes."""
    length = IBAN_LENGTH.get(text[start : start + 2].upper())
    at, chars, end = start, 0, -1
    while chars < (length or 34) and (m := GROUP.match(text, at)) and (at > start or not m.group(1)):
        at, chars = m.end(), chars + len(m.group(2))
        if chars == length or not length and chars <= 34:
            end = at if iban(text[start:at]) else end
    return end


def account_end(text: str, start: int) -> int:
    """Where the number that starts there ends, or -1: the longest run of groups that is one. A group after a space has no
    lower-case letter. One of letters only is of up to four capitals ahead of a group with digits; after a space and a
    whole number, of one."""
    at, digits, end = start, 0, -1
    while digits <= 20 and at - start <= 64 and (m := GROUP.match(text, at)) and (at > start or not m.group(1)):
        sep, group = m.groups()
        if at > start:
            if sep != "-" and group != group.upper():
                break
            if not ASCII_DIGIT.search(group):
                ahead = GROUP.match(text, m.end())
                if not (group.isupper() and len(group) <= 4 and ahead and ASCII_DIGIT.search(ahead.group(2))) or sep == " " and end >= 0 and len(group) > 1:
                    break
        at, digits = m.end(), digits + len(ASCII_DIGIT.findall(group))
        if "0" <= text[at - 1] <= "9" and 5 <= digits <= 20 and at - start >= 8:
            end = at
    return end


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", c))
    a.add_word("@", ("at", "@"))
    a.add_word("+", ("plus", "+"))
    for s in SCHEMES:
        a.add_word(s, ("scheme", s))
    for c in CUES:
        for form in {c, c.upper(), c.capitalize(), c.title()}:
            a.add_word(form, ("cue", form))
    a.make_automaton()
    return a


def scan(text: str, anchors) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order of kind and start."""
    found: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    email_end = ip_end = card_end = phone_end = run_end = 0
    for end, (what, word) in anchors.iter(text):
        if what == "digit":
            if end < run_end:
                continue  # inside a run of digits that has been looked at
            run_end = end + 1
            while run_end < len(text) and "0" <= text[run_end] <= "9":
                run_end += 1
            if end >= ip_end and (m := IP.match(text, end)):
                ip_end = m.end()
                if all(len(x) < 4 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m.group().split("."))):
                    found[1].append(m.span())
            if end >= card_end and (m := CARD.match(text, end)):
                card_end = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found[2].append(m.span())
        elif what == "at":
            start = end
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < end and (m := DOMAIN.match(text, end + 1)):
                email_end = m.end()
                found[0].append((start, email_end))
        elif what == "plus":
            if end >= phone_end and (m := PHONE.match(text, end)):
                phone_end = m.end()
                if 9 <= len(ASCII_DIGIT.findall(m.group())) <= 15:
                    found[3].append(m.span())
        elif what == "scheme":
            start = end - 2
            while start > 0 and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+-."):
                start -= 1
            if start < end - 2 and (m := URL_REST.match(text, end + 1)) and not (found[4] and start < found[4][-1][1]):
                found[4].append((start, m.end()))
        else:
            start = end - len(word) + 1
            if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
                continue
            first = CUE_REST.match(text, end + 1).end()
            if ACCOUNT_START.match(text, first) and not (found[5] and first < found[5][-1][1]):
                last = iban_end(text, first)
                if last < 0 and word.lower() != "iban":
                    last = account_end(text, first)
                if last >= 0:
                    found[5].append((first, last))
    return [(k, a, z) for k, spans in enumerate(found) for a, z in spans]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``spans``, an array of (kind, start, end), by kind as listed and then by start."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([docs.schema[id_col], T.StructField("spans", T.ArrayType(span))])
    kind_t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for b in batches:
            out = [[{"kind": KINDS[k], "start": a, "end": z} for k, a, z in scan(t.as_py() or "", anchors)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind_t)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
