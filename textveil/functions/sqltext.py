"""A Column expression as SQL text, so that SQL functions can be made of what the library builds as columns."""

from __future__ import annotations

from pyspark.sql import Column

# What SQL writes between or before its operands.
INFIX = {"+", "-", "*", "/", "%", "=", "<=>", "<", ">", "<=", ">=", "and", "or", "&", "|", "^"}
PREFIX = {"not": "NOT", "!": "NOT", "negative": "-", "~": "~"}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_text(column: Column) -> str:
    """SQL for an expression of attributes, literals, functions, lambdas, CASE, casts and fields; other nodes are an error."""
    return _text(column._jc.node())


def _text(node) -> str:
    kind = node.getClass().getSimpleName()
    if kind == "Literal":
        return node.sql()
    if kind == "UnresolvedAttribute":
        return ".".join(quoted(x) for x in _items(node.nameParts()))
    if kind == "UnresolvedNamedLambdaVariable":
        return quoted(node.name())
    if kind == "LambdaFunction":
        names = [_text(a) for a in _items(node.arguments())]
        return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {_text(node.function())}"
    if kind == "Alias":
        (name,) = _items(node.name())
        return f"{_text(node.child())} AS {quoted(name)}"
    if kind == "Cast":
        return f"CAST({_text(node.child())} AS {node.dataType().sql()})"
    if kind == "UnresolvedExtractValue":
        return f"({_text(node.child())})[{_text(node.extraction())}]"
    if kind == "CaseWhenOtherwise":
        cases = " ".join(f"WHEN {_text(b._1())} THEN {_text(b._2())}" for b in _items(node.branches()))
        rest = f" ELSE {_text(node.otherwise().get())}" if node.otherwise().isDefined() else ""
        return f"(CASE {cases}{rest} END)"
    if kind == "UnresolvedFunction":
        name, given = node.functionName(), _items(node.arguments())
        low = name.lower()
        if low == "arrays_zip" and all(a.getClass().getSimpleName() == "Alias" for a in given):
            # SQL names the fields by number; the arrays here are of strings
            fields = ", ".join(f"{quoted(_items(a.name())[0])}: STRING" for a in given)
            return f"CAST(arrays_zip({', '.join(_text(a.child()) for a in given)}) AS ARRAY<STRUCT<{fields}>>)"
        args = [_text(a) for a in given]
        if low in INFIX and len(args) == 2:
            return f"({args[0]} {low.upper()} {args[1]})"
        if low in PREFIX and len(args) == 1:
            return f"({PREFIX[low]} {args[0]})"
        if low == "in":
            return f"({args[0]} IN ({', '.join(args[1:])}))"
        return f"{name if low == 'struct' else quoted(name)}({', '.join(args)})"
    raise ValueError(f"{kind} has no SQL text")
