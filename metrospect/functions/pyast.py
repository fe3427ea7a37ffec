"""python_ast profile: the seven metrics of real Python source, one Arrow pass over the texts.

Spark partitions the texts; a task only ever holds the current Arrow batch. Rules follow the public
descriptions of cyclomatic complexity, Halstead measures and the maintainability index.
"""

from __future__ import annotations

import ast
import io
import math
import tokenize
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from metrospect import constants as K
from metrospect.functions.lexical import COMMENT_COEFFICIENT

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
SCOPES = (*FUNCTIONS, ast.ClassDef)
# Kinds of nodes by what the walk does with them; idle ones have no children and count nowhere.
COUNTED = frozenset((*ast.stmt.__subclasses__(), ast.ExceptHandler, ast.match_case))
OPERATES = frozenset((ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.AugAssign, ast.Compare))
DECIDES = frozenset((
    ast.If, ast.IfExp, ast.Assert, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.BoolOp, ast.comprehension, ast.Match,
))
IDLE = frozenset(kind for base in (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop) for kind in base.__subclasses__())


def parse(source: str) -> tuple[ast.Module, bool]:
    """Syntax tree of a text and whether the parser had no warning about it."""
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        tree = ast.parse(source)
    return tree, not caught


def parses_cleanly(source: str) -> bool:
    """True when the text parses and the parser has no warning about it."""
    try:
        return parse(source)[1]
    except Exception:
        return False


def enclosed(tree: ast.Module) -> ast.Module:
    """A module whose statements are the body of one function, for trees that define none at the top."""
    if not tree.body:
        raise IndentationError("a function needs a body")
    nothing = ast.arguments(posonlyargs=[], args=[], kwonlyargs=[], kw_defaults=[], defaults=[])
    function = ast.FunctionDef(name="_module", args=nothing, body=tree.body, decorator_list=[], type_params=[])
    return ast.Module(body=[function], type_ignores=[])


def _branches(node: ast.AST) -> int:
    """Decision points that one node adds."""
    match node:
        case ast.If() | ast.IfExp() | ast.Assert():
            return 1
        case ast.For() | ast.AsyncFor() | ast.While():
            return 1 + bool(node.orelse)
        case ast.Try() | ast.TryStar():
            return len(node.handlers) + bool(node.orelse)
        case ast.BoolOp():
            return len(node.values) - 1
        case ast.comprehension():
            return 1 + len(node.ifs)
        case ast.Match():
            wild = any(
                isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None for c in node.cases
            )
            return max(0, len(node.cases) - wild)
    return 0


def _operand(node: ast.AST) -> object:
    match node:
        case ast.Name():
            return node.id
        case ast.Attribute():
            return node.attr
        case ast.Constant():
            return node.value
    return ast.dump(node)


class Survey:
    """What one walk over a tree finds: statements, free-standing strings, operators and operands with the function around
    them, and the decision points and inner blocks of every function, class and the module."""

    def __init__(self, tree: ast.Module):
        self.statements = self.functions = 0
        self.strings: list[ast.Expr] = []
        self.operators: list[str] = []
        self.operands: list[tuple[str | None, str]] = []
        self.branches: dict[ast.AST, int] = {tree: 0}
        self.inner: dict[ast.AST, list[ast.AST]] = {tree: []}
        self.tree = tree
        self.visit(tree, None, tree)

    def visit(self, node: ast.AST, scope: str | None, block: ast.AST) -> None:
        kind = type(node)
        if kind in DECIDES:
            self.branches[block] += _branches(node)
        if kind in COUNTED:
            self.statements += 1
            if kind is ast.Expr and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
                self.strings.append(node)
            elif kind in SCOPES:
                self.inner[block].append(node)
                self.branches[node], self.inner[node], block = 0, [], node
                if kind in FUNCTIONS:
                    self.functions += 1
        if kind in OPERATES:
            found: list[ast.AST] = []
            match node:
                case ast.BinOp():
                    found = [node.left, node.right]
                case ast.UnaryOp():
                    found = [node.operand]
                case ast.BoolOp():
                    found = list(node.values)
                case ast.AugAssign():
                    found = [node.target, node.value]
                case ast.Compare():
                    found = [node.left, *node.comparators]
            used = node.ops if kind is ast.Compare else [node.op]
            self.operators.extend(type(op).__name__ for op in used)
            self.operands.extend((scope, repr(_operand(n))) for n in found)
        if kind in FUNCTIONS:
            scope = node.name
        for name in kind._fields:
            value = getattr(node, name, None)
            for child in value if type(value) is list else (value,):
                if isinstance(child, ast.AST) and type(child) not in IDLE:
                    self.visit(child, scope, block)

    def block_sizes(self, block: ast.AST | None = None) -> list[int]:
        """Complexity of every outermost function, class and method."""
        sizes = []
        for node in self.inner[block or self.tree]:
            if isinstance(node, FUNCTIONS):
                sizes.append(1 + self.branches[node])
                continue
            methods = self.block_sizes(node)
            if methods:
                sizes.append((self.branches[node] + sum(methods)) // len(methods) + 1)
            else:
                sizes.append(1 + self.branches[node])
            sizes.extend(methods)
        return sizes

    def total_branches(self) -> int:
        """Decision points of the whole module, plus one per function."""
        return sum(self.branches.values()) + self.functions

    def halstead(self) -> tuple[int, int, int, int]:
        """Distinct operators, distinct operands, total operators, total operands."""
        return len(set(self.operators)), len(set(self.operands)), len(self.operators), len(self.operands)


def _comment_lines(source: str, lines: list[str]) -> tuple[int, set[int]]:
    """Number of comments and the lines that hold nothing else."""
    if "'" not in source and '"' not in source:
        # Without strings every '#' starts a comment, so the tokenizer is not needed.
        starts = [(i, line.find("#"), line) for i, line in enumerate(lines, 1) if "#" in line]
    else:
        tokens = tokenize.generate_tokens(io.StringIO(source).readline)
        starts = [(*t.start, t.line) for t in tokens if t.type == tokenize.COMMENT]
    return len(starts), {i for i, column, line in starts if not line[:column].strip()}


def _line_counts(source: str, comments: tuple[int, set[int]], docs: list[ast.Expr]) -> dict[str, int]:
    """Physical lines, source lines, comments, lines of free-standing strings."""
    lines = source.splitlines()
    multi_lines = {
        i for n in docs if n.end_lineno > n.lineno for i in range(n.lineno, n.end_lineno + 1)
    }
    single_docs = {n.lineno for n in docs if n.end_lineno == n.lineno}
    blank = {i for i, line in enumerate(lines, 1) if not line.strip()} - multi_lines
    singles = (comments[1] | single_docs) - multi_lines
    return {
        "loc": len(lines),
        "sloc": len(lines) - len(blank) - len(multi_lines) - len(singles),
        "comments": comments[0],
        "multi": len(multi_lines),
    }


def python_metrics(source: str, tree: ast.Module | None = None) -> dict[str, float]:
    """The seven metrics of one source text; any exception means the text has none."""
    tree = tree or parse(source)[0]
    comments = _comment_lines(source, source.splitlines())
    head = not any(isinstance(node, FUNCTIONS) for node in tree.body)
    if head:
        tree = enclosed(tree)
    found = Survey(tree)
    raw = _line_counts(source, comments, found.strings)
    # The head of the enclosing function is one more line; as a statement the walk has counted it.
    sloc, lloc = raw["sloc"] + head, found.statements
    n1, n2, big_n1, big_n2 = found.halstead()
    volume = (big_n1 + big_n2) * math.log2(n1 + n2) if n1 + n2 else 0.0
    difficulty = n1 / 2 * big_n2 / n2 if n2 else 0.0
    if volume <= 0 or lloc <= 0:
        mi = 100.0
    else:
        share = 100 * (raw["comments"] + raw["multi"]) / sloc if sloc else 0.0
        index = (
            171 - 5.2 * math.log(volume) - 0.23 * found.total_branches()
            - 16.2 * math.log(lloc)
            + 50 * math.sin(math.sqrt(COMMENT_COEFFICIENT * math.radians(share)))
        )
        mi = min(max(0.0, index * 100 / 171), 100.0)
    return {
        "cc": max(found.block_sizes(), default=1),
        "mi": mi,
        "comment_ratio": raw["comments"] / max(raw["loc"] + raw["comments"], 1),
        "h_volume": volume,
        "h_difficulty": difficulty,
        "h_effort": volume * difficulty,
        "sloc": raw["sloc"],
    }


def _annotate(source: str | None) -> dict:
    empty = dict.fromkeys(K.METRICS)
    valid = False
    try:
        tree, valid = parse(source)
        return python_metrics(source, tree) | {"valid": valid, "metrics_error": None}
    except Exception as failure:
        return empty | {"valid": valid, "metrics_error": type(failure).__name__}


def with_python_metrics(df: DataFrame, source: str = "source") -> DataFrame:
    """Add valid, the seven metrics and metrics_error; equal texts of a batch are parsed once."""
    types = {m: T.IntegerType() if m in ("cc", "sloc") else T.DoubleType() for m in K.METRICS}
    types = {"valid": T.BooleanType()} | types | {"metrics_error": T.StringType()}
    extra = [T.StructField(name, kind) for name, kind in types.items()]
    schema = T.StructType(list(df.schema.fields) + extra)

    def annotate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            distinct = {text: _annotate(text) for text in batch[source].drop_duplicates()}
            found = pd.DataFrame([distinct[t] for t in batch[source]], index=batch.index)
            for name in types:
                values = found[name] if len(found) else pd.Series(dtype=object)
                batch[name] = values.astype("Int32") if name in ("cc", "sloc") else values
            yield batch

    return df.mapInPandas(annotate, schema)
