"""Infix expressions over columns, compiled to Column expressions in double precision.

Grammar, lowest precedence first: + and -, * and /, ^ (all left associative), unary minus (binds tighter than ^, so
-2^2 is 4), then numbers, names, name[i], functions and parentheses. Angles are in radians or degrees.
Division by zero gives an infinity or NaN, not null.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|\"(?P<quoted>[^\"]+)\"|(?P<name>[A-Za-z_]\w*)|(?P<sign>[-+*/^(),\[\]]))")


class CalculatorError(ValueError):
    """The expression can't be parsed or names what does not exist."""


def _divide(a: Column, b: Column) -> Column:
    zero = F.when(a > 0, math.inf).when(a < 0, -math.inf).otherwise(math.nan)
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def _log(x: Column) -> Column:
    return F.when(x > 0, F.ln(F.when(x > 0, x).otherwise(1.0))).when(x == 0, -math.inf).otherwise(math.nan)


def _root(a: Column, b: Column) -> Column:
    return F.when(b == 0, math.inf).otherwise(F.pow(a, _divide(F.lit(1.0), b)))


class _Parser:
    def __init__(self, text: str, columns: dict[str, Column], degrees: bool):
        self.columns, self.degrees = columns, degrees
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise CalculatorError(f"unexpected character at {at}: {text[at:at + 10]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, sign: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if sign and token != ("sign", sign):
            raise CalculatorError(f"expected {sign!r}, found {token[1] or 'the end'!r}")
        self.at += 1
        return token

    def binary(self, signs: dict, lower) -> Column:
        left = lower()
        while self.peek()[0] == "sign" and self.peek()[1] in signs:
            f = signs[self.take()[1]]
            left = f(left, lower())
        return left

    def sums(self) -> Column:
        return self.binary({"+": lambda a, b: a + b, "-": lambda a, b: a - b}, self.products)

    def products(self) -> Column:
        return self.binary({"*": lambda a, b: a * b, "/": _divide}, self.powers)

    def powers(self) -> Column:
        return self.binary({"^": lambda a, b: F.pow(a, b)}, self.unary)

    def unary(self) -> Column:
        if self.peek() == ("sign", "-"):
            self.take()
            return -self.unary()
        return self.atom()

    def atom(self) -> Column:
        kind, word = self.take()
        if kind == "number":
            return F.lit(float(word))
        if (kind, word) == ("sign", "("):
            inner = self.sums()
            self.take(")")
            return inner
        if kind == "name" and self.peek() == ("sign", "("):
            return self.call(word)
        if kind in ("name", "quoted"):
            if word not in self.columns:
                raise CalculatorError(f"no column {word!r}")
            column = self.columns[word]
            if self.peek() == ("sign", "["):
                self.take()
                number = self.take()
                if number[0] != "number" or "." in number[1]:
                    raise CalculatorError("a component is a whole number")
                self.take("]")
                column = column[int(number[1])]
            return column.cast("double")
        raise CalculatorError(f"unexpected {word or 'end'!r}")

    def call(self, name: str) -> Column:
        self.take("(")
        arguments = [self.sums()]
        while self.peek() == ("sign", ","):
            self.take()
            arguments.append(self.sums())
        self.take(")")
        into = (lambda c: F.radians(c)) if self.degrees else (lambda c: c)
        out = (lambda c: F.degrees(c)) if self.degrees else (lambda c: c)
        known = {
            "abs": (1, F.abs), "ceil": (1, lambda c: F.ceil(c).cast("double")), "floor": (1, lambda c: F.floor(c).cast("double")),
            "sqrt": (1, F.sqrt), "exp": (1, F.exp), "ln": (1, _log), "log10": (1, lambda c: _log(c) / math.log(10)),
            "log": (2, lambda b, v: _divide(_log(v), _log(b))), "root": (2, _root),
            "sin": (1, lambda c: F.sin(into(c))), "cos": (1, lambda c: F.cos(into(c))), "tan": (1, lambda c: F.tan(into(c))),
            "asin": (1, lambda c: out(F.asin(c))), "acos": (1, lambda c: out(F.acos(c))), "atan": (1, lambda c: out(F.atan(c))),
        }
        if name not in known:
            raise CalculatorError(f"no function {name!r}")
        count, f = known[name]
        if len(arguments) != count:
            raise CalculatorError(f"{name} takes {count} arguments")
        return f(*arguments)


def calculate(expression: str, columns: dict[str, Column] | list[str], degrees: bool = False, to: str = "double") -> Column:
    """The expression as a Column of type to; columns are the names it may use."""
    named = columns if isinstance(columns, dict) else {c: F.col(f"`{c}`") for c in columns}
    parser = _Parser(expression, named, degrees)
    if not parser.tokens:
        raise CalculatorError("empty expression")
    made = parser.sums()
    if parser.peek()[0] != "end":
        raise CalculatorError(f"unexpected {parser.peek()[1]!r}")
    return made.cast(to)
