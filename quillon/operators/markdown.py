"""Markdown of translated text: formulas kept or found, set apart and tidied; asterisks and citations made plain.

A text is cut into formulas and what lies between. Ordered rules, each a pattern
and what becomes of a match, work only between formulas, and what one rule wraps
in dollars is a formula to the next. Braces are matched with a stack; a group
that is never closed stays as it is. Texts are rewritten batch by batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What formulas, citations and candidates look like.
FORMULA = re.compile(r"(?<!\\)\$\$(?:\\.|(?!\$\$).)+?(?<!\\)\$\$|(?<!\\)(?<!\$)\$(?!\$)(?:\\.|[^$\\\n])+(?<!\\)\$(?!\$)", re.DOTALL)
INLINE = re.compile(r"(?<!\\)(?<!\$)\$(?!\$)(?:\\.|[^$\\\n])+(?<!\\)\$(?!\$)")
CITE_COMMAND = re.compile(r"\\(?:cite|citep|citet|autocite|parencite|textcite)\s*\{\s*(?P<body>[^{}]+?)\s*\}")
CITED = r"\d+[A-Za-z]?(?:\s*[-,]\s*\d+[A-Za-z]?)*"
CITE_BRACKET, CITE_SUPER = re.compile(rf"\[\s*({CITED})\s*\]"), re.compile(rf"\^\{{\s*({CITED})\s*\}}")
SUPERSCRIPTS = str.maketrans("0123456789-abcdefghijklmnoprstuvwxyz", "⁰¹²³⁴⁵⁶⁷⁸⁹⁻ᵃᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐⁿᵒᵖʳˢᵗᵘᵛʷˣʸᶻ")
BRACKET = r"(?:\\lbrack|\\rbrack|\\lbrace|\\rbrace|\\langle|\\rangle|[\[\]()])"
GREEK = "A-Za-zΑ-Ωα-ωβΔ"
#: pattern between formulas -> whether its match is tidied (True), taken as it is (False) or has its index braced (None)
PROMOTED: list[tuple[str, bool | None]] = [
    (rf"\^\{{\s*{CITED}\s*\}}", False),
    (rf"\\left\s*{BRACKET}(?:\\.|[^$\n])+?\\right\s*{BRACKET}", True),
    (r"\\[A-Za-z]+(?:\s*\{[^{}]+\})+", True),
    (r"(?<![A-Za-z])[A-Za-z][A-Za-z0-9]*+(?:\([^()\n]+\)|\{[^{}\n]+\}|\^\{[^{}\n]+\}|_\{[^{}\n]+\}|[-/])+", True),
    (r"(?:\[(?=[A-Za-z])[A-Za-z][A-Za-z0-9+\-]*\]){2,}", False),
    (r"\[[A-Za-z0-9_]+\]_[A-Za-z0-9]+", None),
    (rf"\d+(?:\.\d+)?\s*[-+]\s*[{GREEK}]+_[A-Za-z0-9]+", False),
    (rf"(?<![${GREEK}0-9_])[{GREEK}]+_[A-Za-z0-9]+(?![{GREEK}0-9_])", False),
    (r"\{[0-9,\s]+\}\^[A-Za-z0-9]+", False),
]
#: for each of these patterns a set of characters of which every match has all or, for the fourth, one
MARKS = ["^{}", "\\", "\\{}", None, "[]", "[]_", "_", "_", "{}^"]
ATTACHED = re.compile(r"[A-Za-z0-9][({^_/-]")
TRADEMARK, TRADEMARKS = r"\text{®}", {"^®", "^{®}", r"^\circled{R}", r"^\textcircled{R}"}
NAMES = [
    (r"\\begin\{array\}\s*\{[^{}]*\}\s*", ""), (r"\s*\\end\{array\}", ""), (r"\\cal\s+([A-Za-z])", r"\\mathcal{\1}"), (r"\\mathscr\b", r"\\mathcal"), (r"\\rrangle\b", r"\\rangle"), (r"\\llangle\b", r"\\langle"), (r"\\langlen\b", r"\\langle n"),
    (r"\\Breve\b", r"\\breve"), (r"\\Vec\b", r"\\vec"), (r"\\textsuperscript\s*\{\s*([^{}]+?)\s*\}", r"^{\1}"), (r"\\circled\s*\{\s*\\times\s*\}", r"\\otimes"), (r"\\circled\s*\{\s*\\parallel\s*\}", r"\\circ"), (r"\\circled\s*\{\s*([^{}]+?)\s*\}", r"\1"),
    (r"\\textcircled\s*\{\s*\\times\s*\}", r"\\otimes"), (r"\\textcircled\s*\{\s*\\scriptsize\s*\{\s*\\parallel\s*\}\s*\}", r"\\circ"), (r"\\textcircled\s*\{\s*\\parallel\s*\}", r"\\circ"), (r"\\textcircled\s*\{\s*([^{}]+?)\s*\}", r"\1"),
    (r"\\(?:scriptstyle|scriptscriptstyle|textstyle|displaystyle)\b", ""),
]
SPACED_LETTERS = [r"\\mathrm\s*\{\s*\{\s*([A-Za-z0-9](?:\s+[A-Za-z0-9])+)\s*\}\s*\}", r"\\mathrm\s*\{\s*([A-Za-z0-9](?:\s+[A-Za-z0-9])+)\s*\}"]
DOTS = [(r"(?<=\d)\s*\\dot\b(?=\s*$)", "."), (r"(?<=\d)\s*\\dot\b(?=\s*[\)\],;])", ".")]
STYLES = r"(?:pmb|bf|rm|it|sf|tt|em)"
STYLED = [r"\{\s*\\" + STYLES + r"\s+([^{}]+?)\s*\}", r"\\" + STYLES + r"\s*\{\s*([^{}]+?)\s*\}"]
UNWRAPPED = ({"smash", "mbox", "hbox", "vbox", "fbox", "textnormal", "textrm", "textsf", "texttt"}, {"textbf", "textit", "emph", "em"})
LEFTOVERS = [(r"\{\s*\\(?:bf|rm|it|tt|sf|pmb)\s*\}", ""), (r"^\{\s*([^{}]+?)\s*\}$", r"\1"), (r"\bC\s*0\s*0\s*H(?=\s*\^\s*\{\s*\*\s*\})", "COOH")]
SUPER_IN_MATHRM = r"\\mathrm\s*\{\s*([A-Za-z0-9]+)\s*\^\s*\{\s*([^{}]+?)\s*\}\s*\}"
NOISE = [
    (r"(?<=\d)\s*\.\s*(?=\d)", "."), (r"(?<=\d)\s+(?=\d)", ""), (r"~\s*\\mathrm\s*\{\s*e\s*V\s*\}\s*\.?", r" \\mathrm{eV}"), (r"\\vec\s*\{\s*([A-Za-z])\s*\}", r"\1"), (r"\\bf\s*\{\s*([A-Za-z0-9\-+*/]+)\s*\}", r"\1"),
    (r"\{\s*\\bf\s+([^{}]+?)\s*\}", r"{\1}"), (r"^\{\s*([A-Za-z])\s*\}(?=\s+\{)", r"\1"), (r"\s*([,.;:])\s*$", ""),
]
SCRIPT_GROUPS = (r"_\s*\{\s*([^{}]+?)\s*\}", r"\^\s*\{\s*([^{}]+?)\s*\}")
SCRIPTS = [
    (r"(?<=[A-Za-z0-9\}\)\]])\s*_\s*([A-Za-z0-9*+\-]+)", r"_\1"), (r"(?<=[A-Za-z0-9\}\)\]])\s*\^\s*([A-Za-z0-9*+\-]+)", r"^\1"), (r"(?<=[A-Za-z0-9\}\)\]])\s*\^\s*(\\[A-Za-z]+)", r"^\1"),
    (r"(\\[A-Za-z]+|[A-Za-z0-9\}\)\]])\s+(_\{[^{}]*\})", r"\1\2"), (r"(\\[A-Za-z]+|[A-Za-z0-9\}\)\]])\s+(\^\{[^{}]*\})", r"\1\2"), (r"\^\s+\*", "^*"),
]
HYPHENS = [(r"((?:\\[A-Za-z]+|[A-Za-z])[A-Za-z0-9]*)\s*-\s*((?:\\[A-Za-z]+|[A-Za-z])[A-Za-z0-9]*)", r"\1-\2")]
SPACES = [(r"\.\s+([\)\],;])", r".\1"), (r"(?<=\d)\s*\.\s*(?=\d)", "."), (r"(?<=\d)\s+(?=\d)", ""), (r"\s*([=+*/<>:,;])\s*", r" \1 "), (r"((?:\d+|[)\]}]|\\[A-Za-z]+))\s*-\s*((?:\d+|[(\[{]|\\[A-Za-z]+))", r"\1 - \2")]
LAST = [(r"(?<=\^)\s+([*+\-])", r"\1"), (r"\^([*+\-])\s+(?=[}\)])", r"^\1")]
ENDINGS = [(r"\\mathrm\s*\{\s*COOH\s*\^\s*\{\s*\*\s*\}\s*\}", r"\\mathrm{COOH^{*}}"), (r"^([_^])\{([^{}]+)\}$", r"\1{{\2}}")]
CIRCLED = [(r"\\textcircled\s*\{\s*\\scriptsize\s*\{\s*\\parallel\s*\}\s*\}", r"$\\circ$"), (r"\\textcircled\s*\{\s*\\parallel\s*\}", r"$\\circ$"), (r"\\textcircled\s*\{\s*\\times\s*\}", r"$\\otimes$")]
TIGHT_BEFORE, TIGHT_AFTER = "([{\"'“‘（【「『", ".,;:!?)]}，。！？；：、（）【】「」『』"


def rewritten(text: str, rules: Iterable[tuple[str, str]]) -> str:
    for pattern, by in rules:
        text = re.sub(pattern, by, text)
    return text


def settled(text: str, step: Callable[[str], str]) -> str:
    """The text after a step that no longer changes it."""
    while (new := step(text)) != text:
        text = new
    return text


def closing(text: str) -> dict[int, int]:
    """Where each opened brace is closed, by a stack; braces left open or closed without need aren't in it."""
    opened, pairs = [], {}
    for i, c in enumerate(text):
        if c == "{":
            opened.append(i)
        elif c == "}" and opened:
            pairs[opened.pop()] = i
    return pairs


def unwrapped(text: str, names: set[str]) -> str:
    r"""The text with ``\name{inner}`` replaced by its tidied inner part for some names; unclosed groups stay."""
    pairs, out, at = closing(text), [], 0
    for m in re.finditer(r"\\([^\W\d_]*)\s*(?=\{)", text):
        if m.start() >= at and m[1] in names and m.end() in pairs:
            out += [text[at : m.start()], tidy(text[m.end() + 1 : pairs[m.end()]])]
            at = pairs[m.end()] + 1
    return "".join([*out, text[at:]])


def _scripts(text: str) -> str:
    def once(t: str) -> str:
        for pattern in SCRIPT_GROUPS:
            t = re.sub(pattern, lambda m: m[0][0] + "{" + _scripts(m[1].strip()) + "}", t)
        return rewritten(t, SCRIPTS)

    return settled(text, once)


def tidy(formula: str) -> str:
    """A formula in the form that typesetting takes: known names, no style and layout wrappers, even spaces."""
    f = " ".join(formula.split())
    if not f or f in TRADEMARKS:
        return TRADEMARK if f else f
    f = rewritten(f, NAMES)
    for pattern in SPACED_LETTERS:
        f = re.sub(pattern, lambda m: "\\mathrm{" + re.sub(r"\s+", "", m[1]) + "}", f)
    f = rewritten(f, DOTS)

    def plain(t: str) -> str:
        for pattern in STYLED:
            t = re.sub(pattern, lambda m: "{" + m[1].strip() + "}", t)
        return t

    f = settled(f, plain)
    for names in UNWRAPPED:
        f = unwrapped(f, names)
    f = rewritten(f, LEFTOVERS)
    f = re.sub(SUPER_IN_MATHRM, lambda m: "\\mathrm{" + m[1] + "^{" + re.sub(r"\s+", "", m[2]) + "}}", f)
    f = _scripts(rewritten(f, NOISE))
    f = settled(f, lambda t: rewritten(t, HYPHENS))
    f = rewritten(_scripts(rewritten(f, SPACES)), LAST)
    f = rewritten(re.sub(r"\s+", " ", f).strip(), ENDINGS)
    return "{} " + f if f.startswith(("_", "^")) else f


def between(text: str, change: Callable[[str], str]) -> str:
    """The text with what lies between its formulas changed."""
    if "$" not in text:
        return change(text)
    out, at = [], 0
    for m in FORMULA.finditer(text):
        out += [change(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, change(text[at:])])


def citation(body: str) -> str:
    return re.sub(r"\s+", "", body)


def plain_citation(formula: str) -> str | None:
    """A formula that is nothing but a citation as plain text, else None."""
    f = " ".join(formula.split())
    if m := CITE_BRACKET.fullmatch(f):
        return f"[{citation(m[1])}]"
    if m := CITE_SUPER.fullmatch(f):
        return citation(m[1]).translate(SUPERSCRIPTS)
    return None


def _promoted(m: re.Match, tidied: bool | None) -> str:
    f = m[0].strip()
    if tidied is None:
        f = re.sub(r"_([A-Za-z0-9]+)$", r"_{\1}", f)
    return f"${tidy(f) if tidied else f}$"


def spaced(text: str) -> str:
    """Formulas with a space on either side, unless a bracket, a mark or the edge stands there."""
    out, at = [], 0
    for m in FORMULA.finditer(text):
        before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        out += [text[at : m.start()], " " if before and not before.isspace() and before not in TIGHT_BEFORE else "", m[0], " " if after and not after.isspace() and after not in TIGHT_AFTER else ""]
        at = m.end()
    return re.sub(r"[ \t]{2,}", " ", "".join([*out, text[at:]])).strip()


def markdown(text: str | None, promote: bool = True, tidy_inline: bool = False) -> str:
    """One text as Markdown; see ``to_markdown``."""
    cites = lambda t: CITE_COMMAND.sub(lambda m: citation(m["body"]).translate(SUPERSCRIPTS) or m[0], re.sub(r"\\{2,}(?=[A-Za-z])", r"\\", t))
    t = between(" ".join((text or "").split()), cites)
    for (pattern, tidied), marks in zip(PROMOTED, MARKS) if promote else ():
        if not (ATTACHED.search(t) if marks is None else all(c in t for c in marks)):
            continue
        t = between(t, lambda plain, p=pattern, k=tidied: re.sub(p, lambda m: _promoted(m, k), plain))
    t = between(t, lambda plain: plain.replace("*", r"\*"))
    if tidy_inline:
        t = INLINE.sub(lambda m: m[0] if not m[0][1:-1].strip() else plain_citation(m[0][1:-1]) or f"${tidy(m[0][1:-1])}$", t)
    return rewritten(spaced(t), CIRCLED)


def to_markdown(promote: bool = True, tidy_inline: bool = False):
    """A column function from text to Markdown.

    ``promote`` looks for formulas outside dollars; ``tidy_inline`` rewrites
    those inside, and citations among them as text. A null is an empty text.
    """

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: markdown(t, promote, tidy_inline))

    return run


@F.pandas_udf(T.StringType())
def tidy_formula(formulas: pd.Series) -> pd.Series:
    """Formulas in the form that typesetting takes; a null is empty."""
    return formulas.map(lambda f: tidy(f or ""))
