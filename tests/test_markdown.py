import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.operators import markdown as K


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("", ""), ("  ", ""), ("^®", r"\text{®}"), (r"\mathrm { a b c }", r"\mathrm{abc}"), (r"\cal A + b", r"\mathcal{A} + b"), (r"{\bf x} _ { i }", "{x}_{i}"), ("x _ 1", "x_1"), ("1 2 . 5", "12.5"),
        (r"\mbox{a {b} c}", "a {b} c"), (r"\textbf{\textit{n}}", "n"), (r"\mbox{a {b c", r"\mbox{a {b c"), ("^{2}", "{} ^{{2}}"), ("a=b", "a = b"), (r"\circled{\times}", r"\otimes"), ("x ^ { 2 } y", "x^{2} y"), (r"3 \dot", "3"),
        (r"\mathrm{COOH ^ { * }}", r"\mathrm{COOH^{*}}"), ("a - b", "a-b"), ("3 - 4", "3 - 4"), ("x,", "x"),
    ],
)
def test_tidy(formula, want):
    assert K.tidy(formula) == want


@pytest.mark.parametrize(
    ("text", "promote", "inline", "want"),
    [
        (None, True, False, ""), (" a\n b ", True, False, "a b"), ("x_1 is", True, False, "$x_1$ is"), ("a*b $c*d$", True, False, r"a\*b $c*d$"), ("a*b x_1", False, False, r"a\*b x_1"),
        (r"see \cite{12, 3-4}.", True, False, "see ¹²,³⁻⁴."), ("seen^{1,2}", True, False, "seen $^{1,2}$"), ("so$x$is", True, False, "so $x$ is"), ("($x$), and", True, False, "($x$), and"),
        ("cited $[1, 2]$ and $^{3}$", True, True, "cited [1,2] and ³"), ("$ x _ 1 $", True, True, "$x_1$"), ("$ x _ 1 $", True, False, "$ x _ 1 $"), (r"\textcircled{\times} is", False, False, r"$\otimes$ is"),
        (r"\\alpha{x} on", True, False, r"$\alpha{x}$ on"), ("[Na][Cl] pair", True, False, "$[Na][Cl]$ pair"), ("[ab]_cd on", True, False, "$[ab]_{cd}$ on"), ("5 dollars $ open", True, False, "5 dollars $ open"),
    ],
)
def test_markdown(spark, text, promote, inline, want):
    assert K.markdown(text, promote, inline) == want
    assert spark.createDataFrame([(text,)], "t string").select(K.to_markdown(promote, inline)(F.col("t"))).first()[0] == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["$", "$$", "{", "}", r"\mbox{", r"\textbf", "a", " ", "x_1", "*", r"\$", "^", "[1]", "\n"]), max_size=14).map("".join))
def test_unbalanced_input(text):
    """Whatever is left open: nothing raises, formulas stay as they are, letters keep their order, and asterisks outside formulas are escaped."""
    out = K.markdown(text, promote=False)
    at = 0
    for m in K.FORMULA.findall(" ".join(text.split())):  # a space beside a formula may set off another one
        at = out.index(m, at) + len(m)
    assert re.sub(r"[\s\\]", "", out) == re.sub(r"[\s\\]", "", text)
    assert not re.search(r"(?<!\\)\*", K.between(out, str)) or "$" in out
    K.tidy(text), K.markdown(text, True, True)
    pairs = K.closing(text)
    assert all(text[a] == "{" and text[b] == "}" and a < b for a, b in pairs.items())


def test_again_changes_nothing():
    for text in ("x_1 is $y$ and [ab]_cd", r"see \cite{4} on"):
        once = K.markdown(text)
        assert K.markdown(once) == once
