"""Formula text read once from left to right: what no pattern can bound, brackets and what stands before a blank."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.xml import as_column

# Marks the last blank after a word: what follows is no reference. The second one stands for other white space.
AFTER_WORD, AFTER_WORD_BREAK = "\ue000", "\ue001"
TOKEN = re.compile(r'"(?:[^"]|"")*+"|[A-Za-z0-9_.]+|\s+|.', re.DOTALL)
TABLE_NAME = re.compile(r"(?:^|(?<=\.))[A-Za-z_][A-Za-z0-9_.]*$")


def _closings(formula: str) -> dict[int, int]:
    """Where each bracket outside strings is closed."""
    out, open_ = {}, []
    for m in TOKEN.finditer(formula):
        if m.group() == "[":
            open_.append(m.start())
        elif m.group() == "]" and open_:
            out[open_.pop()] = m.start()
    return out


def masked(formula: str) -> tuple[str, list[str]]:
    """The formula without strings and table references, and the table references.

    A table reference is a name and its bracket, with brackets inside to any depth.
    """
    closing = _closings(formula) if "[" in formula else {}
    out: list[str] = []
    tables: list[str] = []
    word, at = "", 0  # the word that only white space separates from here
    while at < len(formula):
        m = TOKEN.match(formula, at)
        token, at = m.group(), m.end()
        if token[0] == '"' and len(token) > 1:
            out.append(" ")
            word = ""
        elif token.isspace():
            lettered = any("a" <= c <= "z" or "A" <= c <= "Z" for c in word)
            out.append(token[:-1] + (AFTER_WORD if token[-1] == " " else AFTER_WORD_BREAK) if lettered else token)
        elif token[0].isalnum() and token.isascii() or token[0] in "_.":
            gap = re.compile(r"\s*").match(formula, at).end()
            name = TABLE_NAME.search(token)
            if name and formula[gap : gap + 1] == "[" and gap in closing:
                end = closing[gap] + 1
                tables.append(formula[m.start() + name.start() : end])
                out += [token[: name.start()], " "]
                word, at = "", end
            else:
                out.append(token)
                word = token
        else:
            out.append(token)
            word = ""
    return "".join(out), tables


def split_formula(formula) -> Column:
    """``struct<clean, tables>`` of ``masked``."""
    @F.pandas_udf("struct<clean: string, tables: array<string>>")
    def split(texts: pd.Series) -> pd.DataFrame:
        found = [(None, []) if t is None else masked(t) for t in texts]
        return pd.DataFrame({"clean": [c for c, _ in found], "tables": [t for _, t in found]})

    return split(as_column(formula))
