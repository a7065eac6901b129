"""Chat templates as column expressions: loops over messages become transforms of an array, conditions CASE expressions.

A template is read once, on the driver; what comes of it is one native expression for any number of rows. The template
language is the part of Jinja that chat templates use; its expressions are read by Python's own parser.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT, TRUTH, NUMBER = T.StringType(), T.BooleanType(), T.LongType()
_PIECES = re.compile(r"(\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\})", re.DOTALL)


@dataclass(eq=False)
class Value:
    """A column and its type; of a name that is not defined, none."""

    col: Column | None
    kind: T.DataType | None

    def text(self) -> Column:
        """As it is written out: null as nothing."""
        return F.lit("") if self.col is None else F.coalesce(self.col.cast("string"), F.lit(""))

    def truth(self) -> Column:
        """Whether it counts as true: texts and lists that are not empty, numbers that are not 0."""
        if self.col is None:
            return F.lit(False)
        if isinstance(self.kind, T.BooleanType):
            told = self.col
        elif isinstance(self.kind, T.StringType):
            told = self.col != ""
        elif isinstance(self.kind, T.ArrayType):
            told = F.size(self.col) > 0
        elif isinstance(self.kind, T.NumericType):
            told = self.col != 0
        else:
            told = self.col.isNotNull()
        return F.coalesce(told, F.lit(False))


NOTHING = Value(None, None)
FILTERS = {
    "trim": lambda v: Value(F.regexp_replace(v.text(), "^\\s+|\\s+$", ""), TEXT),
    "upper": lambda v: Value(F.upper(v.text()), TEXT),
    "lower": lambda v: Value(F.lower(v.text()), TEXT),
    "length": lambda v: Value((F.length(v.text()) if isinstance(v.kind, T.StringType) else F.size(v.col)).cast("long"), NUMBER),
    "string": lambda v: Value(v.text(), TEXT),
}


class _Expression:
    """An expression's value in a scope of names."""

    def __init__(self, scope: dict[str, Value | dict]):
        self.scope = scope

    def value(self, source: str) -> Value:
        strings = re.compile(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")")
        parts = strings.split(source.strip())
        parts[::2] = [p.replace("~", "+") for p in parts[::2]]
        return self.of(ast.parse("".join(parts), mode="eval").body)

    def of(self, node: ast.expr) -> Value:
        made = getattr(self, f"_{type(node).__name__.lower()}", None)
        if made is None:
            raise ValueError(f"a template can't hold {ast.unparse(node)}")
        return made(node)

    def _constant(self, node):
        kinds = {str: TEXT, bool: TRUTH, int: NUMBER}
        return NOTHING if node.value is None else Value(F.lit(node.value), kinds[type(node.value)])

    def _name(self, node):
        known = {"true": Value(F.lit(True), TRUTH), "false": Value(F.lit(False), TRUTH), "none": NOTHING}
        return self.scope.get(node.id, known.get(node.id, NOTHING))

    def _member(self, owner: Value | dict, name) -> Value:
        if isinstance(owner, dict):
            return owner.get(name, NOTHING)
        if isinstance(owner.kind, T.ArrayType) and isinstance(name, int):
            return Value(F.try_element_at(owner.col, F.lit(name + 1 if name >= 0 else name)), owner.kind.elementType)
        if isinstance(owner.kind, T.StructType) and name in owner.kind.names:
            return Value(owner.col[name], owner.kind[name].dataType)
        return NOTHING

    def _attribute(self, node):
        return self._member(self.of(node.value), node.attr)

    def _subscript(self, node):
        return self._member(self.of(node.value), ast.literal_eval(node.slice))

    def _boolop(self, node):
        truths = [self.of(v).truth() for v in node.values]
        out = truths[0]
        for t in truths[1:]:
            out = out & t if isinstance(node.op, ast.And) else out | t
        return Value(out, TRUTH)

    def _unaryop(self, node):
        if isinstance(node.op, ast.Not):
            return Value(~self.of(node.operand).truth(), TRUTH)
        return Value(-self.of(node.operand).col, NUMBER)

    def _binop(self, node):
        if isinstance(node.op, ast.BitOr):
            name = node.right.func.id if isinstance(node.right, ast.Call) else node.right.id
            return FILTERS[name](self.of(node.left))
        left, right = self.of(node.left), self.of(node.right)
        numbers = isinstance(left.kind, T.NumericType) and isinstance(right.kind, T.NumericType)
        if isinstance(node.op, ast.Add):
            return Value(left.col + right.col, NUMBER) if numbers else Value(F.concat(left.text(), right.text()), TEXT)
        return Value({ast.Sub: lambda a, b: a - b, ast.Mod: F.pmod, ast.Mult: lambda a, b: a * b}[type(node.op)](left.col, right.col), NUMBER)

    def _ifexp(self, node):
        return Value(F.when(self.of(node.test).truth(), self.of(node.body).text()).otherwise(self.of(node.orelse).text()), TEXT)

    def _compare(self, node):
        op, right = node.ops[0], node.comparators[0]
        left = self.of(node.left)
        if isinstance(op, ast.Is | ast.IsNot):
            kinds = {"string": T.StringType, "iterable": T.ArrayType, "mapping": T.StructType}
            name = right.id if isinstance(right, ast.Name) else "none"
            if name in kinds:
                told = F.lit(isinstance(left.kind, kinds[name]))
            else:
                there = F.lit(False) if left is NOTHING else F.lit(True) if isinstance(left, dict) else left.col.isNotNull()
                told = there if name == "defined" else ~there
            return Value(~told if isinstance(op, ast.IsNot) else told, TRUTH)
        if isinstance(op, ast.In | ast.NotIn):
            if isinstance(right, ast.List | ast.Tuple):
                told = left.text().isin(*[ast.literal_eval(e) for e in right.elts])
            else:
                told = F.contains(self.of(right).text(), left.text())
            return Value(~told if isinstance(op, ast.NotIn) else told, TRUTH)
        right = self.of(right)
        if left is NOTHING or right is NOTHING:
            told = F.lit(left is right)
        else:
            told = left.col.eqNullSafe(right.col)
        orders = {ast.Lt: lambda: left.col < right.col, ast.Gt: lambda: left.col > right.col, ast.LtE: lambda: left.col <= right.col, ast.GtE: lambda: left.col >= right.col}
        if type(op) in orders:
            return Value(F.coalesce(orders[type(op)](), F.lit(False)), TRUTH)
        return Value(told if isinstance(op, ast.Eq) else ~told, TRUTH)


def _nodes(template: str) -> list[tuple]:
    """The template as (kind, what): texts, outputs and tags, blanks around tags taken away as chat templates are read: a tag takes the
    blanks before it on its line and the line's end behind it; a minus takes all blanks on its side."""
    pieces, out = _PIECES.split(template), []
    for i, piece in enumerate(pieces):
        if i % 2 == 0:
            before, after = pieces[i - 1] if i else "", pieces[i + 1] if i + 1 < len(pieces) else ""
            if before[:2] in ("{%", "{#"):
                piece = piece.removeprefix("\n")
            if before[-3:-2] == "-":
                piece = piece.lstrip()
            if after[:2] in ("{%", "{#"):
                piece = re.sub(r"(^|\n)[ \t]*$", r"\1", piece) if i or piece.strip(" \t") != piece or not piece.strip() else piece
            if after[2:3] == "-":
                piece = piece.rstrip()
            if piece:
                out.append(("text", piece))
        elif piece[:2] != "{#":
            inside = piece[2:-2].strip("-").strip()
            out.append(("out", inside) if piece[:2] == "{{" else ("tag", inside))
    return out


class _Body:
    """Nodes up to a tag that ends them, as one text column."""

    def __init__(self, nodes: list[tuple]):
        self.nodes, self.at = nodes, 0

    def until(self, scope: dict, ends: tuple[str, ...]) -> tuple[Column, str]:
        parts = [F.lit("")]
        while self.at < len(self.nodes):
            kind, what = self.nodes[self.at]
            word = what.split(None, 1)[0] if kind == "tag" else ""
            if word in ends:
                return F.concat(*parts), what
            self.at += 1
            if kind == "text":
                parts.append(F.lit(what))
            elif kind == "out":
                parts.append(_Expression(scope).value(what).text())
            elif word == "for":
                parts.append(self._loop(what, scope))
            elif word == "if":
                parts.append(self._choice(what[2:], scope))
            elif word == "set":
                name, _, source = what[3:].partition("=")
                scope = {**scope, name.strip(): _Expression(scope).value(source)}
            else:
                raise ValueError(f"a template can't hold the tag {word}")
        if ends:
            raise ValueError(f"a template lacks {ends[-1]}")
        return F.concat(*parts), ""

    def _loop(self, what: str, scope: dict) -> Column:
        name, source = re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", what, re.DOTALL).groups()
        over, began, made = _Expression(scope).value(source), self.at, []
        if not isinstance(over.kind, T.ArrayType):
            raise ValueError(f"a template can't loop over {source}")

        def one(item: Column, i: Column) -> Column:
            self.at, n = began, F.size(over.col)
            loop = {"index0": Value(i.cast("long"), NUMBER), "index": Value((i + 1).cast("long"), NUMBER), "first": Value(i == 0, TRUTH), "last": Value(i == n - 1, TRUTH), "length": Value(n.cast("long"), NUMBER)}
            made.append(self.until({**scope, name: Value(item, over.kind.elementType), "loop": loop}, ("endfor",)))
            return made[-1][0]

        out = F.coalesce(F.array_join(F.transform(over.col, one), ""), F.lit(""))
        self.at += 1
        return out

    def _choice(self, test: str, scope: dict) -> Column:
        cases, other = [], F.lit("")
        while True:
            truth = _Expression(scope).value(test).truth()
            body, end = self.until(scope, ("elif", "else", "endif"))
            self.at += 1
            cases.append((truth, body))
            if end.startswith("elif"):
                test = end[4:]
                continue
            if end == "else":
                other, _ = self.until(scope, ("endif",))
                self.at += 1
            break
        out = F.when(*cases[0])
        for truth, body in cases[1:]:
            out = out.when(truth, body)
        return out.otherwise(other)


def rendered(template: str, messages: Column, kind: T.DataType, add_generation_prompt: bool = False, **variables: str | Column) -> Column:
    """The text that ``template`` makes of ``messages``, an array of structs of the type ``kind``. Further variables are texts.

    Loops (with ``loop``), conditions, ``set``, concatenation, comparisons, tests of being defined, ``trim``, ``upper``, ``lower`` and ``length`` are known; any
    other part is an error at once, not a wrong text. Nulls are written as nothing, and so are names that are not defined; a
    null array gives what the template makes of no messages.
    """
    scope = {"messages": Value(messages, kind), "add_generation_prompt": Value(F.lit(add_generation_prompt), TRUTH)}
    scope |= {k: Value(F.lit(v) if isinstance(v, str) else v, TEXT) for k, v in variables.items()}
    return _Body(_nodes(template)).until(scope, ())[0]
