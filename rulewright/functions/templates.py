"""Level-1 URI templates, and the texts they make."""

from __future__ import annotations

import re

from .terms import RuleError

_OPERATORS = "+#./;?&=,!@|"
_NAME = re.compile(r"[A-Za-z0-9_]+")


def parse_template(text: str) -> list[tuple[str, str]]:
    """('text' or 'slot', value) parts of a template such as ``https://x.org/order/{number}``."""
    out: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        cut = text.find("{", at)
        fixed = text[at:] if cut < 0 else text[at:cut]
        if "}" in fixed:
            raise RuleError(f"template {text!r} has a stray '}}'")
        if fixed:
            out.append(("text", fixed))
        if cut < 0:
            break
        end = text.find("}", cut)
        if end < 0:
            raise RuleError(f"template {text!r} has an unterminated slot")
        name = text[cut + 1 : end]
        if not name:
            raise RuleError(f"template {text!r} has an empty slot")
        if name[0] in _OPERATORS:
            raise RuleError(f"template {text!r} uses the operator {name[0]!r}; only plain slots are supported")
        if not _NAME.fullmatch(name):
            raise RuleError(f"template {text!r} has an illegal slot name {name!r}")
        out.append(("slot", name))
        at = end + 1
    return out


def template_slots(text: str) -> list[str]:
    return list(dict.fromkeys(v for kind, v in parse_template(text) if kind == "slot"))


def ambiguous_separators(text: str) -> list[str]:
    """Texts between two slots that encoded values can contain too, so that different values may make one IRI; nothing
    between slots is the empty string."""
    parts, out = parse_template(text), []
    last = None
    for k, (kind, value) in enumerate(parts):
        if kind == "slot":
            if last is not None:
                between = "".join(v for _, v in parts[last + 1 : k])
                if not re.search(r"[^A-Za-z0-9._~%-]", between):
                    out.append(between)
            last = k
    return out


def regex_quote(text: str) -> str:
    """A pattern that matches just the text."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def render(content: str, bindings: dict[str, str]) -> str:
    """The content with ``{{key}}`` replaced for the keys that are given; other braces stay."""
    for k, v in bindings.items():
        content = content.replace("{{" + k + "}}", v)
    return content
