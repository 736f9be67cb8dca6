"""CSS selectors on the tree of a page."""

from __future__ import annotations

import re
from functools import lru_cache

from pagewright.kernel.tree import Node

_PART = re.compile(
    r"(?P<comb>\s*[>+~]\s*|\s+)|(?P<tag>\*|[a-zA-Z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]"
    r"|:(?P<pseudo>[\w-]+)(?:\((?P<arg>[^()]*(?:\([^()]*\)[^()]*)*)\))?"
)


class SelectorError(ValueError):
    """A selector that can't be read."""


@lru_cache(maxsize=512)
def compile_selector(selector: str) -> tuple:
    """Alternatives of a selector, each a tuple of (combinator, tests) from left to right."""
    out = []
    for one in _split(selector):
        steps, tests, comb, at = [], [], "", 0
        text = one.strip()
        if not text:
            raise SelectorError(selector)
        while at < len(text):
            m = _PART.match(text, at)
            if not m:
                raise SelectorError(selector)
            at = m.end()
            if m["comb"] is not None:
                steps.append((comb, tuple(tests)))
                comb, tests = m["comb"].strip() or " ", []
            elif m["tag"]:
                tests.append(("tag", m["tag"].lower()))
            elif m["id"]:
                tests.append(("id", m["id"]))
            elif m["cls"]:
                tests.append(("cls", m["cls"]))
            elif m["attr"]:
                value = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), None)
                tests.append(("attr", m["attr"].lower(), m["op"], value))
            else:
                arg = m["arg"]
                if m["pseudo"] not in ("not", "is", "where", "has", "first-child", "last-child", "only-child", "nth-child", "first-of-type", "last-of-type", "empty", "root"):
                    raise SelectorError(selector)
                tests.append(("pseudo", m["pseudo"], compile_selector(arg) if m["pseudo"] in ("not", "is", "where", "has") else arg))
        steps.append((comb, tuple(tests)))
        out.append(tuple(steps))
    return tuple(out)


def _split(selector: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(selector):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            parts.append(selector[start:i])
            start = i + 1
    return [*parts, selector[start:]]


def _siblings(node: Node) -> list[Node]:
    return [c for c in node.parent.children if c.tag and c.tag[0] != "#"] if node.parent else [node]


def _nth(arg: str | None, place: int) -> bool:
    arg = (arg or "").replace(" ", "").lower()
    arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", arg)
    if not m:
        return False
    if m[3]:
        return place == int(m[3])
    a = {"": 1, "+": 1, "-": -1}.get(m[1], None)
    a = int(m[1]) if a is None else a
    rest = place - int(m[2] or 0)
    return rest == 0 if a == 0 else rest % a == 0 and rest // a >= 0


def _fits(node: Node, tests: tuple) -> bool:
    for t in tests:
        kind = t[0]
        if kind == "tag":
            ok = t[1] == "*" or node.tag == t[1]
        elif kind == "id":
            ok = node.attrs.get("id") == t[1]
        elif kind == "cls":
            ok = t[1] in node.attrs.get("class", "").split()
        elif kind == "attr":
            have, op, want = node.attrs.get(t[1]), t[2], t[3]
            ok = have is not None and (
                op is None or (op == "=" and have == want) or (op == "~=" and want in have.split()) or (op == "|=" and (have == want or have.startswith(f"{want}-")))
                or (bool(want) and ((op == "^=" and have.startswith(want)) or (op == "$=" and have.endswith(want)) or (op == "*=" and want in have)))
            )
        else:
            name, arg = t[1], t[2]
            if name in ("not", "is", "where"):
                ok = any(_matches(node, steps) for steps in arg) != (name == "not")
            elif name == "has":
                ok = any(_matches(x, steps) for x in node.elements() if x is not node for steps in arg)
            elif name == "empty":
                ok = not any(c.tag != "#comment" for c in node.children)
            elif name == "root":
                ok = node.parent is None or node.parent.tag == "#root"
            else:
                kin = _siblings(node)
                if name.endswith("of-type"):
                    kin = [k for k in kin if k.tag == node.tag]
                place = next(i for i, k in enumerate(kin) if k is node)
                ok = {"first": place == 0, "last": place == len(kin) - 1, "only": len(kin) == 1, "nth": _nth(arg, place + 1)}[name.split("-")[0]]
        if not ok:
            return False
    return True


def _matches(node: Node, steps: tuple) -> bool:
    comb, tests = steps[-1]
    if not _fits(node, tests):
        return False
    if len(steps) == 1:
        return True
    rest = steps[:-1]
    if comb == ">":
        return node.parent is not None and node.parent.tag != "#root" and _matches(node.parent, rest)
    if comb == " ":
        up = node.parent
        while up is not None and up.tag != "#root":
            if _matches(up, rest):
                return True
            up = up.parent
        return False
    kin = _siblings(node)
    before = kin[: next(i for i, k in enumerate(kin) if k is node)]
    return bool(before) and (_matches(before[-1], rest) if comb == "+" else any(_matches(k, rest) for k in before))


def select(root: Node, selector: str) -> list[Node]:
    """Elements that match, in document order."""
    alternatives = compile_selector(selector)
    return [n for n in root.elements() if any(_matches(n, steps) for steps in alternatives)]
