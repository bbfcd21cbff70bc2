"""Lexical rules of a dump, written once as regular expressions that Java and Python read alike.

A line splits into tokens: strings, numbers, names, brackets and other single characters. Forms that
a dump repeats millions of times (``[key] = number,``, ``number,``, ``[key] = {``) are one token each
where they stand on one line. A comment or a string may stay open at the end of a line; what would
close it is the state in which the next line begins: empty, a quote, or a long bracket.
"""

from __future__ import annotations

import re

#: White space of the dump's language, and how many ``=`` a long bracket may have.
BLANK, LEVELS = r"[ \t\r\n\x0b\f]", 4

NUMBER = r"-?[0-9]++(?:\.[0-9]*+)?+(?:[eE][-+]?[0-9]++)?+"
NAME = r"[A-Za-z_][A-Za-z0-9_]*+"
_INSIDE = {'"': r'(?:[^"\\]++|\\.)*+', "'": r"(?:[^'\\]++|\\.)*+"}
STRING = "|".join(f"{q}{body}{q}" for q, body in _INSIDE.items())
_LONG = "|".join(rf"\[{'=' * n}\[.*?\]{'=' * n}\]" for n in range(LEVELS))
_KEY = rf"\[{BLANK}*+(?:{NUMBER}|{STRING}){BLANK}*+\]{BLANK}*+={BLANK}*+"

#: In this order: comments (closed long, open long, to the end), strings (likewise), whole entries, single tokens.
TOKEN = "(?s)" + "|".join([
    rf"--(?:{_LONG})", r"--\[=*+\[.*+", r"--.*+", _LONG, r"\[=*+\[.*+", STRING, *[f"{q}{body}\\\\?" for q, body in _INSIDE.items()],
    rf"{_KEY}{NUMBER}{BLANK}*+[,;]", rf"{_KEY}\{{", rf"{NUMBER}{BLANK}*+[,;]", NUMBER, NAME, rf"[^ \t\r\n\x0b\f]"])

#: Whole-token patterns of the fused forms: ``[key] = number,`` (key, number), ``[key] = {`` (key), ``number,`` (number).
ENTRY = rf"(?s)\[{BLANK}*+({NUMBER}|{STRING}){BLANK}*+\]{BLANK}*+={BLANK}*+({NUMBER}){BLANK}*+[,;]"
OPEN_KEYED = rf"(?s)\[{BLANK}*+({NUMBER}|{STRING}){BLANK}*+\]{BLANK}*+={BLANK}*+\{{"
ITEM = rf"({NUMBER}){BLANK}*+[,;]"
OPEN_LONG = r"(?s)(?:--)?\[(=*+)\[.*+"
#: Texts that stay open or are long: for the grammar any string is as good.
OPAQUE = rf"(?s)^(?:\[=*+\[.*+|\"{_INSIDE['"']}\\?+\Z|'{_INSIDE["'"]}\\?+\Z)"
#: Lines that may change the state in which the next line begins, or where the state of this one matters.
TURNS = r"(?s)\[=*+\[|\]=*+\]|\\\Z"

#: Every state a line can begin in.
STATES = ["", '"', "'", *[f"]{'=' * n}]" for n in range(LEVELS)]]
#: What a line that begins inside a quoted string takes up to its closing quote.
UNTIL_QUOTE = {q: f"(?s)^{body}{q}" for q, body in _INSIDE.items()}

_token, _open_long, _opaque = re.compile(TOKEN), re.compile(OPEN_LONG), re.compile(OPAQUE)
_until = {q: re.compile(p) for q, p in UNTIL_QUOTE.items()}


def lex_line(line: str, state: str) -> tuple[list[str], str]:
    """The tokens of a line that begins in ``state``, and the state in which the next line begins."""
    if state in _until:
        found = _until[state].match(line)
        if found is None:
            return [], state if line.endswith("\\") else ""
        line = line[found.end():]
    elif state:
        at = line.find(state)
        if at < 0:
            return [], state
        line = line[at + len(state):]
    tokens = _token.findall(line)
    state = ""
    if tokens:
        last = tokens[-1]
        found = _open_long.fullmatch(last)
        if found:
            closer = f"]{found[1]}]"
            state = closer if closer not in last else ""
        elif last[0] in _until and not (len(last) > 1 and _until[last[0]].fullmatch(last, 1)):
            state = last[0] if last.endswith("\\") else ""
    return ['""' if _opaque.match(t) else t for t in tokens if not t.startswith("--")], state
