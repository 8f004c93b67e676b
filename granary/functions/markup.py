"""Element paths in XML and HTML, told by where elements begin and end.

A text becomes its tags, comments and runs of text, each whole; a fold over them keeps the names of the open elements and how
many of them, from the root, are the path's.  So marks in comments, CDATA sections and attributes are no elements, and an
element counts below its ancestors only.  The state is as deep as the text nests, and no row meets another.  The fold runs in
Arrow batches, once for all tests of a path, and ends where the last element of the path's name does.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements of HTML that have no end tag, and those that hold no markup.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
RAW = ("script", "style", "textarea")

_SPACE = r" \t\n\x0b\f\r"
_ATTRIBUTES = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
_OTHER = r"(?P<cdata>!\[CDATA\[[\s\S]*?(?:\]\]>|\Z))|(?P<nothing>!--[\s\S]*?(?:-->|\Z)|\?[\s\S]*?(?:\?>|\Z)|![^>]*+>?)"
_TAG = rf"(?P<tag>/?[^\W\d]{_ATTRIBUTES}>)"
_XML = re.compile(f"<(?:{_OTHER}|{_TAG})")
_HTML = re.compile(rf"<(?:{_OTHER}|(?P<raw>(?ai:(?P<what>{'|'.join(RAW)})(?=[{_SPACE}/>]){_ATTRIBUTES}>[\s\S]*?(?:</(?P=what)[{_SPACE}]*>|\Z)))|{_TAG})")
_NAME = re.compile(rf"</?(?:[^{_SPACE}/>:]*:)?([^{_SPACE}/>:]*)")
_IS_HTML = re.compile(rf"(?ai)\ufeff?[{_SPACE}]*(?:<!--[\s\S]*?-->[{_SPACE}]*)*<(?:!doctype[{_SPACE}]+html|html)\b")

# Entities of XML.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _plain(text: str) -> str:
    for entity, mark in _ENTITIES:
        text = text.replace(entity, mark)
    return text


def _values(text: str, steps: Sequence[str]) -> list[str]:
    """The text of each element at the path, up to the first element that ends; names are without their prefix, those of HTML in lower case."""
    low = text.lower()
    last = low.rfind(steps[-1].lower()) if len(low) == len(text) else len(text)
    html = _IS_HTML.match(text) is not None
    stack, counts, met, taking, out, at = [], Counter(), 0, None, [], 0
    for m in (_HTML if html else _XML).finditer(text) if last >= 0 else ():
        if taking is None and m.start() > last:
            break
        kind, piece = m.lastgroup, m.group()
        if taking is not None:
            taking += _plain(text[at : m.start()]) + (piece[9:].removesuffix("]]>") if kind == "cdata" else "")
        at = m.end()
        if kind in ("cdata", "nothing") or not piece.endswith(">"):
            continue
        name = _NAME.match(piece)[1]
        name = name.lower() if html else name
        if piece.startswith("</"):
            # An end tag ends the nearest element of its name, with those left open inside; without one it ends nothing.
            while counts[name]:
                gone = stack.pop()
                counts[gone] -= 1
                if gone == name:
                    break
            met, ends = min(met, len(stack)), True
        else:
            ends = name in VOID or name in RAW if html else piece.endswith("/>")
            fits = len(stack) == met < len(steps) and steps[met] == name
            if fits and met == len(steps) - 1:
                taking = ""
            if not ends:
                stack.append(name)
                counts[name] += 1
                met += fits
        if ends and taking is not None:
            out.append(taking)
            taking = None
    return out


@cache
def _udf(steps: tuple[str, ...]) -> Callable[[Column], Column]:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else _values(t, steps) for t in texts], dtype=object)

    return run


def has_element(text: Column, steps: Sequence[str], test: Callable[[Column], Column] | None = None) -> Column:
    """Whether an element lies at the path of names from the root, and whether a test holds for the text of one that does.

    Null and texts without the last name have none; an element that never ends is none; an empty path is none.
    Elements of HTML whose end tags are left out hold what follows until an ancestor ends.
    """
    if not steps:
        return F.lit(False)
    return F.exists(_udf(tuple(steps))(text), test or (lambda _: F.lit(True)))
