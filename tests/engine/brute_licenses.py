"""License expressions by recursive descent, to hold the column functions against."""

import re

from granary.functions import licenses as L


def normal(name: str) -> str:
    plain = name.strip().strip("\"'")
    return L.KNOWN.get(plain.lower(), plain)


_TOKEN = re.compile(r"\(|\)|[^\s()]+")


def parse(text: str):
    """An expression as a name or (operator, left, right); OR binds loosest, WITH tightest.

    What does not parse to its end is one name as it stands.
    """
    tokens = _TOKEN.findall(text.replace("||", " OR ").replace("&&", " AND "))
    at = 0

    def peek() -> str:
        return tokens[at].upper() if at < len(tokens) else ""

    def atom():
        nonlocal at
        if at >= len(tokens):
            return None
        token = tokens[at]
        at += 1
        if token == "(":
            inner = level(0)
            if peek() == ")":
                at += 1
            return inner
        return token

    def level(k: int):
        nonlocal at
        if k == 3:
            return atom()
        left = level(k + 1)
        while left is not None and peek() == ("OR", "AND", "WITH")[k]:
            at += 1
            right = level(k + 1)
            if right is None:
                return left
            left = (("OR", "AND", "WITH")[k], left, right)
        return left

    found = level(0)
    return found if at == len(tokens) and found is not None else text.strip()


def expression_category(expression) -> str:
    """AND takes the more severe side, OR the less severe one, the left of equals; WITH is judged by its license."""
    if isinstance(expression, str):
        return L.CATEGORY_OF.get(normal(expression).lower(), "unknown")
    op, left, right = expression
    a, b = expression_category(left), expression_category(right)
    if op == "WITH":
        return a
    return (a if L.SEVERITY[a] >= L.SEVERITY[b] else b) if op == "AND" else (a if L.SEVERITY[a] <= L.SEVERITY[b] else b)


def leaves(tree) -> list[str]:
    """The licenses of an expression from left to right, without exceptions."""
    if isinstance(tree, str):
        return [tree]
    return leaves(tree[1]) + ([] if tree[0] == "WITH" else leaves(tree[2]))


def names(text: str) -> list[str]:
    """The licenses an expression names, normalised, each once, in order."""
    return list(dict.fromkeys(normal(x) for x in leaves(parse(text)) if x and x.upper() not in ("OR", "AND", "WITH")))
