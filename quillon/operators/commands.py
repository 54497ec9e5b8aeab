"""Command lines inside text: the prefix of command tokens, line kinds and the decision what of a block is literal.

A text is read once: its tokens become small codes, and a fold over the codes
carries the state of an automaton (how many tokens belong to the command,
whether the last one asks for a value, what speaks for a command, how many words
stand behind it). So the work is in proportion to the text's length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import rules as Q
from quillon.functions import text as X
from quillon.functions.text import let

# What command tokens look like.
COMMAND_HEAD = r"^[A-Za-z][\p{L}\p{N}_.-]{0,31}$"
COMMAND_FLAG = r"^-{1,2}[A-Za-z0-9][\p{L}\p{N}_.-]*$"
COMMAND_FILE = r"^[A-Za-z0-9_.-]+\.[A-Za-z0-9]{1,8}$"
COMMAND_NUMBER = r"^-?\d+(?:\.\d+)?$"
COMMAND_ARGUMENT = r"^<[^<>\n]+>$"
COMMAND_OPERATORS = (">", "<", "|", "||", "&&", "2>", "1>", ">>", "=", ":")
PREFIX_TOKENS, PREFIX_EVIDENCE, PROSE_WORDS, LONG_WORDS, LINE_LETTERS = 3, 2, 6, 8, 24

#: kinds of tokens by bit
FLAG, FILE, ARGUMENT, NUMBER, OPERATOR, PATH, ASSIGNED = (1 << k for k in range(7))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def long_words(text: Column) -> Column:
    """English words of three letters or more."""
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(X.WORD), F.lit(0)), lambda w: F.length(w) >= 3))


def kinds(token: Column) -> Column:
    """Bits of what a token looks like."""
    bit = lambda c, b: F.when(c, b).otherwise(0)
    return (
        bit(token.rlike(COMMAND_FLAG), FLAG) + bit(token.rlike(COMMAND_FILE), FILE) + bit(token.rlike(COMMAND_ARGUMENT), ARGUMENT) + bit(token.rlike(COMMAND_NUMBER), NUMBER)
        + bit(token.isin(*COMMAND_OPERATORS), OPERATOR) + bit(token.rlike(r"[/\\=]"), PATH) + bit(token.contains("_"), ASSIGNED)
    )


def has(code: Column, bits: int) -> Column:
    return code.bitwiseAND(F.lit(bits)) != 0


def command_head(token: Column) -> Column:
    """A first token that names a command: small letters, or a digit, dot or hyphen in it."""
    return token.rlike(COMMAND_HEAD) & ((F.lower(token) == token) | token.rlike(r"[\p{N}.-]"))


def _run(codes: Column) -> Column:
    """The automaton's last state over an array of (code, words): n tokens taken, kinds seen in them and behind the head, numbers, words behind."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"), F.lit(False).alias("asks"), F.lit(0).alias("all"), F.lit(0).alias("tail"), F.lit(0).alias("numbers"), F.lit(0).alias("words"))

    def step(s: Column, t: Column) -> Column:
        code = t["code"]
        take = s["open"] & ((s["n"] == 0) | (code != 0) | s["asks"])
        later = take & (s["n"] > 0)
        return F.struct(
            (s["n"] + take.cast("int")).alias("n"), take.alias("open"), has(code, FLAG | OPERATOR).alias("asks"),
            F.when(take, s["all"].bitwiseOR(code)).otherwise(s["all"]).alias("all"), F.when(later, s["tail"].bitwiseOR(code)).otherwise(s["tail"]).alias("tail"),
            (s["numbers"] + (later & has(code, NUMBER)).cast("int")).alias("numbers"), (s["words"] + F.when(take, 0).otherwise(t["words"])).alias("words"),
        )

    return F.aggregate(codes, start, step)


def command_prefix(text: Column) -> Column:
    """The longest run of command tokens at a text's start, or ''.

    A token belongs if it looks like a command's value or follows an operator
    or a flag. The run needs three tokens, evidence worth 2, and six words of
    prose (three letters or more) behind it.
    """

    def judged(found: Column) -> Column:
        head = F.get(found, F.lit(0))
        worth = lambda c, points: F.when(c, points).otherwise(0)
        evidence = lambda s: (
            worth(has(s["tail"], FLAG), 2) + worth(has(s["tail"], FILE), 2) + worth(has(s["tail"], ARGUMENT), 2) + worth(has(s["all"], OPERATOR), 2)
            + worth(s["numbers"] >= 2, 1) + worth(has(s["tail"], PATH), 1) + worth(head.rlike(r"[\p{N}.-]"), 1)
        )
        taken = lambda s: (s["n"] >= PREFIX_TOKENS) & (evidence(s) >= PREFIX_EVIDENCE) & (s["words"] >= PROSE_WORDS)
        codes = lambda ts: F.transform(ts, lambda t: F.struct(kinds(t).alias("code"), long_words(t).alias("words")))
        begins = _run(codes(F.slice(found, 1, PREFIX_TOKENS)))["n"] == PREFIX_TOKENS  # most texts fail here, so that the rest isn't read
        prefix = let(_run(codes(found)), lambda s: F.when(taken(s), F.array_join(F.slice(found, F.lit(1), F.greatest(s["n"], F.lit(1))), " ")).otherwise(""))
        return F.when((F.size(found) >= PREFIX_TOKENS) & command_head(head) & begins, prefix).otherwise("")

    return let(tokens(text), judged)


def command_line(text: Column) -> Column:
    """A line that begins with a command's prefix, or whose head is a command and whose tokens speak for one."""

    def judged(found: Column) -> Column:
        head = F.get(found, F.lit(0))
        signs = F.exists(found, lambda t: t.rlike(COMMAND_FLAG)) | (F.size(F.filter(found, lambda t: t.rlike(COMMAND_FILE) | t.rlike(COMMAND_NUMBER))) >= 2) | F.exists(found, lambda t: t.isin(*COMMAND_OPERATORS))
        return F.coalesce(command_head(head) & signs, F.lit(False))

    return (command_prefix(text) != "") | let(tokens(text), judged)


def prose_line(text: Column) -> Column:
    return let(X.normalize_space(text), lambda s: (long_words(s) >= PROSE_WORDS) & (F.regexp_count(s, F.lit(r"\p{L}")) >= LINE_LETTERS))


def mixed_block(lines: Column) -> Column:
    """Lines of which one is a command and one is prose."""
    return F.exists(lines, command_line) & F.exists(lines, prose_line)


def local_decision(text: Column, lines: Column) -> Column:
    """(action, prefix, by): what of a block is translated, by rules on its text and lines.

    Nothing of an empty or code text; the tail of one that begins with a command;
    all of plain prose. Where the rules don't decide, the number of tokens with a
    letter and three characters does (``by`` fallback).
    """
    verdict = lambda action, prefix, by: F.struct(F.lit(action).alias("action"), prefix.alias("prefix"), F.lit(by).alias("by"))
    none = F.lit("")

    def ladder(s: Column) -> Column:
        worded = F.size(F.filter(tokens(s), lambda t: t.rlike(r"\p{L}") & (F.length(t) >= 3)))
        return let(
            command_prefix(s),
            lambda prefix: F.when(s == "", verdict("keep_all", none, "local"))
            .when(Q.code_literal(s), verdict("keep_all", none, "local"))
            .when(prefix != "", verdict("translate_tail", prefix, "local"))
            .when(~mixed_block(lines) & (long_words(s) >= LONG_WORDS), verdict("translate_all", none, "local"))
            .when(worded >= LONG_WORDS, verdict("translate_all", none, "fallback"))
            .otherwise(verdict("keep_all", none, "fallback")),
        )

    return let(X.normalize_space(text), ladder)
