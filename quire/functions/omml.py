"""Office math to presentation MathML and LaTeX.

One walk over the tree gives both notations at once: each structure has a rule from its parts' (MathML, LaTeX) pairs to
its own. Structures without a rule keep their children and are reported, so the status is `partial`; what does not
parse, holds a DOCTYPE or has no content is `failed`. Operator, accent and LaTeX tables are fixed values.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable
from html import escape

import pyarrow as pa

from ._udf import arrow

M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
TEXT = M + "t"
MATHML = "http://www.w3.org/1998/Math/MathML"
# Fixed values.
OPERATORS = set("+-=≈≤≥×÷∑∫√()[]{}|,")
BIG = {"∑": r"\sum", "∫": r"\int", "√": r"\sqrt"}
ACCENTS = {"^": ("^", "hat"), "ˆ": ("^", "hat"), "¯": ("¯", "bar"), "̅": ("¯", "bar"), "˙": ("˙", "dot"), ".": ("˙", "dot"), "~": ("~", "tilde"), "˜": ("~", "tilde")}
CONTAINERS = {"oMath", "oMathPara", "e", "num", "den", "sup", "sub", "deg"}
FEATURES = {"f": "fraction", "sSup": "superscript", "sSub": "subscript", "sSubSup": "subsup", "rad": "radical", "nary": "nary_limits", "m": "matrix", "eqArr": "equation_array", "d": "delimiter"}
RESULT = "struct<mathml:string,latex:string,conversion_status:string,supported_features:array<string>,unsupported_features:array<string>>"

Pair = tuple[str, str]


def _tag(name: str, *parts: str, **attributes: str) -> str:
    if not attributes:
        return f"<mml:{name}>{''.join(parts)}</mml:{name}>"
    return f"<mml:{name}{''.join(f' {k}=' + chr(34) + escape(v) + chr(34) for k, v in attributes.items())}>{''.join(parts)}</mml:{name}>"


def _token(text: str, operator: bool = False) -> str:
    text = text.strip()
    if not text:
        return ""
    name = "mo" if operator or text in OPERATORS else "mn" if text.isdigit() else "mi"
    return f"<mml:{name}>{text if text.isalnum() else escape(text, quote=False)}</mml:{name}>"


def _group(latex: str) -> str:
    return latex if len(latex) <= 1 else "{" + latex + "}"


class _Walk:
    rules: dict[str, Callable[[_Walk, ET.Element], Pair]]

    def __init__(self) -> None:
        self.supported, self.unsupported = set(), set()

    def value(self, node: ET.Element, name: str, default: str) -> str:
        found = node.find(f".//{M}{name}")
        return (found.get(f"{M}val") or default) if found is not None else default

    def part(self, node: ET.Element, name: str) -> Pair:
        """A part as one MathML element and LaTeX; a missing one is empty."""
        child = node.find(M + name)
        mathml, latex = self.row(child) if child is not None else ("", "")
        return _tag("mrow", mathml), latex

    def row(self, node: ET.Element) -> Pair:
        pairs = [self.walk(c) for c in node]
        if len(pairs) == 1:
            return pairs[0]
        return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)

    def walk(self, node: ET.Element) -> Pair:
        name = node.tag.removeprefix(M)
        if name == "r" or name == "t":
            text = "".join(t.text or "" for t in node.iter(TEXT))
            return _token(text), text
        if name.endswith("Pr"):
            return "", ""
        rule = self.rules.get(node.tag)
        if rule:
            if name in FEATURES and not (name == "d" and self.is_cases(node)):
                self.supported.add(FEATURES[name])
            return rule(self, node)
        if name not in CONTAINERS and node.tag.startswith(M):
            self.unsupported.add(f"omml_{name}")
        return self.row(node)

    def scripts(self, node: ET.Element, tag: str, names: str) -> Pair:
        base, *rest = (self.part(node, n) for n in ("e", *names.split()))
        marks = {"sub": "_", "sup": "^"}
        return _tag(tag, base[0], *(r[0] for r in rest)), _group(base[1]) + "".join(marks[n] + "{" + r[1] + "}" for n, r in zip(names.split(), rest))

    def on_f(self, node: ET.Element) -> Pair:
        top, low = self.part(node, "num"), self.part(node, "den")
        return _tag("mfrac", top[0], low[0]), rf"\frac{{{top[1]}}}{{{low[1]}}}"

    def on_sSup(self, node: ET.Element) -> Pair:
        return self.scripts(node, "msup", "sup")

    def on_sSub(self, node: ET.Element) -> Pair:
        return self.scripts(node, "msub", "sub")

    def on_sSubSup(self, node: ET.Element) -> Pair:
        return self.scripts(node, "msubsup", "sub sup")

    def on_rad(self, node: ET.Element) -> Pair:
        body, degree = self.part(node, "e"), self.part(node, "deg")
        return (_tag("mroot", body[0], degree[0]), rf"\sqrt[{degree[1]}]{{{body[1]}}}") if degree[1] else (_tag("msqrt", body[0]), rf"\sqrt{{{body[1]}}}")

    def on_nary(self, node: ET.Element) -> Pair:
        sign = self.value(node, "chr", "∑")
        low, high, body = (self.part(node, n) for n in ("sub", "sup", "e"))
        used = [p for p in (low, high) if p[1]]
        tag = "munderover" if len(used) == 2 else "munder" if low[1] else "mover"
        mathml = _tag(tag, _token(sign, True), *(p[0] for p in used)) if used else _token(sign, True)
        latex = BIG.get(sign, r"\sum") + (f"_{{{low[1]}}}" if low[1] else "") + (f"^{{{high[1]}}}" if high[1] else "")
        return _tag("mrow", mathml, body[0]), latex + _group(body[1])

    def table(self, rows: list[list[ET.Element]], environment: str) -> Pair:
        cells = [[self.row(c) for c in r] for r in rows]
        mathml = _tag("mtable", *(_tag("mtr", *(_tag("mtd", _tag("mrow", c[0])) for c in r)) for r in cells))
        return mathml, rf"\begin{{{environment}}}" + r" \\ ".join(" & ".join(c[1] for c in r) for r in cells) + rf"\end{{{environment}}}"

    def on_m(self, node: ET.Element) -> Pair:
        return self.table([r.findall(M + "e") for r in node.findall(M + "mr")], "matrix")

    def on_eqArr(self, node: ET.Element, environment: str = "aligned") -> Pair:
        return self.table([[e] for e in node.findall(M + "e")], environment)

    def on_acc(self, node: ET.Element) -> Pair:
        body, accent = self.part(node, "e"), ACCENTS.get(self.value(node, "chr", ""))
        if not accent:
            self.unsupported.add("complex_accent")
            return body
        self.supported.add(f"accent_{accent[1]}")
        return _tag("mover", body[0], _token(accent[0], True), accent="true"), rf"\{accent[1]}{{{body[1]}}}"

    def is_cases(self, node: ET.Element) -> bool:
        return node.tag == M + "d" and self.value(node, "begChr", "(") == "{" and node.find(f".//{M}eqArr") is not None

    def on_d(self, node: ET.Element) -> Pair:
        first, last = self.value(node, "begChr", "("), self.value(node, "endChr", ")")
        if self.is_cases(node):
            self.supported |= {"cases", "equation_array"}
            mathml, latex = self.on_eqArr(node.find(f".//{M}eqArr"), "cases")
            return _tag("mfenced", mathml, open="{", close=""), latex
        body = self.part(node, "e")
        return _tag("mrow", _token(first, True), body[0], _token(last, True)), first + body[1] + last


#: The rule of each element that has one.
_Walk.rules = {M + name.removeprefix("on_"): rule for name, rule in vars(_Walk).items() if name.startswith("on_")}


def converted(omml: str | None) -> dict:
    walk, failed = _Walk(), {"mathml": "", "latex": "", "conversion_status": "failed", "supported_features": [], "unsupported_features": []}
    try:
        if not omml or "<!DOCTYPE" in omml.upper():
            raise ET.ParseError
        mathml, latex = walk.walk(ET.fromstring(omml))
    except ET.ParseError:
        return failed | {"unsupported_features": ["invalid_omml"]}
    if not latex.strip():
        return failed
    return {
        "mathml": f'<mml:math xmlns:mml="{MATHML}">{mathml}</mml:math>', "latex": latex.strip(), "conversion_status": "partial" if walk.unsupported else "success",
        "supported_features": sorted(walk.supported), "unsupported_features": sorted(walk.unsupported),
    }


@arrow(RESULT, arrays=True)
def omml_to_math(omml: pa.Array) -> pa.Array:
    done = [converted(x) for x in omml.to_pylist()]
    strings, lists = pa.string(), pa.list_(pa.string())
    kinds = {"mathml": strings, "latex": strings, "conversion_status": strings, "supported_features": lists, "unsupported_features": lists}
    return pa.StructArray.from_arrays([pa.array([x[k] for x in done], t) for k, t in kinds.items()], list(kinds))
