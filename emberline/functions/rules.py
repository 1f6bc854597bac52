"""Rules: a condition on a span, as text, becomes two columns, whether it matches and whether it failed.

    or-expression   := and-expression { "or" and-expression }
    and-expression  := not-expression { "and" not-expression }
    not-expression  := [ "not" ] comparison
    comparison      := sum [ ( "==" | "!=" | "<" | "<=" | ">" | ">=" ) sum ]
    sum             := product { ( "+" | "-" ) product }
    product         := value { ( "*" | "/" ) value }
    value           := literal | path | call | "-" value | "(" or-expression ")"

Paths are span.<field>, span.attributes["key"], resource.attributes["key"], scope.name and scope.version.
Functions are those of FUNCTIONS, with the number of their arguments. Durations and times are numbers of
nanoseconds: Duration reads text such as "1h30m", Seconds and its kin tell how many a duration holds, Unix
makes a time of seconds, and UnixNano and its kin tell a time's number since 1970.

What a condition needs but can't have, such as an integer of a map, is an error; it never matches and never
stops a query. What is missing compares as nil: equal to nil alone, neither less nor greater. Values of
different types are unequal, but integers compare with floating-point numbers.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.config import duration_ns

# Names of numbers.
ENUMS = {
    "STATUS_CODE_UNSET": 0, "STATUS_CODE_OK": 1, "STATUS_CODE_ERROR": 2,
    "SPAN_KIND_UNSPECIFIED": 0, "SPAN_KIND_INTERNAL": 1, "SPAN_KIND_SERVER": 2, "SPAN_KIND_CLIENT": 3, "SPAN_KIND_PRODUCER": 4, "SPAN_KIND_CONSUMER": 5,
}
FIELDS = {
    "span.name": ("name", "string"), "span.kind": ("kind", "int"), "span.trace_state": ("trace_state", "string"),
    "span.start_time_unix_nano": ("start_ns", "int"), "span.end_time_unix_nano": ("end_ns", "int"),
    "span.status.code": ("status_code", "int"), "span.status.message": ("status_message", "string"), "span.status": ("status_code", "int"),
    "span.trace_id.string": ("trace_id", "string"), "span.span_id.string": ("span_id", "string"),
    "scope.name": ("scope_name", "string"), "scope.version": ("scope_version", "string"), "instrumentation_scope.name": ("scope_name", "string"),
}
ATTRIBUTES = {"span": "attributes", "resource": "resource_attributes", "scope": "scope_attributes"}
TOKEN = re.compile(r"""\s*(?:(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+)|(?P<text>"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_][\w.]*)|(?P<sign>==|!=|<=|>=|[<>+\-*/()\[\],]))""")
FUNCTIONS = {
    "Int": 1, "Double": 1, "String": 1, "IsMatch": 2, "IsString": 1, "IsInt": 1, "IsBool": 1, "IsDouble": 1, "IsMap": 1, "IsList": 1, "Len": 1, "Concat": 2, "ToLowerCase": 1,
    "ToUpperCase": 1, "ConvertCase": 2, "HasPrefix": 2, "HasSuffix": 2, "Substring": 3, "Trim": 1, "Index": 2, "Abs": 1, "MD5": 1, "SHA1": 1, "SHA256": 1, "Nanoseconds": 1,
    "Microseconds": 1, "Milliseconds": 1, "Seconds": 1, "Duration": 1, "Unix": 1, "UnixNano": 1, "UnixMicro": 1, "UnixMilli": 1, "UnixSeconds": 1,
}
#: Functions of text alone: what they make of it, and its kind.
OF_TEXT = {
    "ToLowerCase": (F.lower, "string"), "ToUpperCase": (F.upper, "string"), "Trim": (F.trim, "string"), "MD5": (lambda t: F.md5(t.cast("binary")), "string"),
    "SHA1": (lambda t: F.sha1(t.cast("binary")), "string"), "SHA256": (lambda t: F.sha2(t.cast("binary"), 256), "string"),
}
#: Nanoseconds of a unit. Durations and times are numbers of nanoseconds.
UNITS = {"Nanoseconds": 1, "Microseconds": 1_000, "Milliseconds": 1_000_000, "Seconds": 1_000_000_000}


@dataclasses.dataclass
class Value:
    """What a part of a condition yields. kind: int, float, string, bool, nil or any (a variant)."""

    column: Column
    kind: str
    error: Column


#: Yields the column of a field or attribute: (kind of place, key) -> (column, kind).
Lookup = Callable[[str, str], tuple[Column, str]]


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise ValueError(f"{sign} expected at {self.peek()!r}")

    def whole(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.peek()!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        tree = self.summed()
        if sign := self.take("==", "!=", "<=", ">=", "<", ">"):
            tree = (sign, tree, self.summed())
        return tree

    def summed(self):
        tree = self.multiplied()
        while sign := self.take("+", "-"):
            tree = (sign, tree, self.multiplied())
        return tree

    def multiplied(self):
        tree = self.single()
        while sign := self.take("*", "/"):
            tree = (sign, tree, self.single())
        return tree

    def single(self):
        if self.take("("):
            tree = self.either()
            self.need(")")
            return tree
        if self.take("-"):
            return ("-", ("literal", 0), self.single())
        if self.at >= len(self.tokens):
            raise ValueError("the condition ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return ("literal", float(text) if "." in text else int(text))
        if kind == "text":
            return ("literal", re.sub(r"\\(.)", r"\1", text[1:-1]))
        if kind != "name":
            raise ValueError(f"unexpected {text!r}")
        if text in ("true", "false"):
            return ("literal", text == "true")
        if text == "nil":
            return ("literal", None)
        if text in ENUMS:
            return ("literal", ENUMS[text])
        if self.take("("):
            if text not in FUNCTIONS:
                raise ValueError(f"unknown function {text}")
            given = [] if self.peek() == ")" else [self.either()]
            while self.take(","):
                given.append(self.either())
            self.need(")")
            if len(given) != FUNCTIONS[text]:
                raise ValueError(f"{text} takes {FUNCTIONS[text]} arguments")
            if text in ("ConvertCase", "Duration", "Substring") and any(x[0] != "literal" for x in given[0 if text == "Duration" else 1 :]):
                raise ValueError(f"{text} takes literals")
            if text == "ConvertCase" and given[1][1] not in ("lower", "upper"):
                raise ValueError("ConvertCase takes lower or upper")
            if text == "Duration":
                return ("literal", duration_ns(str(given[0][1])))
            if text == "IsMatch":
                if given[1][0] != "literal" or not isinstance(given[1][1], str):
                    raise ValueError("IsMatch takes a literal pattern")
                try:
                    re.compile(given[1][1])
                except re.error as e:
                    raise ValueError(f"bad pattern: {e}") from e
            return ("call", text, given)
        place, _, field = text.rpartition(".")
        if field == "attributes" and place in ATTRIBUTES:
            self.need("[")
            kind, key = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "text":
                raise ValueError("an attribute's key is text in quotes")
            self.at += 1
            self.need("]")
            return ("attribute", place, key[1:-1])
        if text not in FIELDS:
            raise ValueError(f"unknown path {text}")
        return ("field", text)


def _number(v: Value) -> tuple[Column, Column]:
    """(column, error) of v as a number; nil stays nil."""
    if v.kind in ("int", "float"):
        return v.column, v.error
    if v.kind == "any":
        type_ = F.schema_of_variant(v.column)
        n = F.try_variant_get(v.column, "$", "double")
        whole = F.try_variant_get(v.column, "$", "bigint")
        numeric = type_.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
        return F.when(numeric, F.when(type_.rlike("^(DOUBLE|FLOAT)"), n).otherwise(whole)), v.error | F.coalesce(~numeric, F.lit(False))
    if v.kind == "nil":
        return F.lit(None).cast("bigint"), v.error
    return F.lit(None).cast("bigint"), F.lit(True)


def _compile(tree, look: Lookup) -> Value:
    false = F.lit(False)
    op = tree[0]
    if op == "literal":
        x = tree[1]
        if x is None:
            return Value(F.lit(None).cast("string"), "nil", false)
        kind = "bool" if isinstance(x, bool) else "int" if isinstance(x, int) else "float" if isinstance(x, float) else "string"
        return Value(F.lit(x).cast("bigint") if kind == "int" else F.lit(x), kind, false)
    if op == "field":
        column, kind = look("field", tree[1])
        return Value(column, kind, false)
    if op == "attribute":
        column, kind = look(tree[1], tree[2])
        return Value(column, kind, false)
    if op in ("and", "or"):
        a, b = _truth(_compile(tree[1], look)), _truth(_compile(tree[2], look))
        # The second part isn't evaluated where the first one settles it, nor its errors counted.
        settled = ~a.column if op == "and" else a.column
        return Value((a.column & b.column) if op == "and" else (a.column | b.column), "bool", a.error | (~a.error & ~settled & b.error))
    if op == "not":
        a = _truth(_compile(tree[1], look))
        return Value(~a.column, "bool", a.error)
    if op in ("+", "-", "*", "/"):
        a, b = _compile(tree[1], look), _compile(tree[2], look)
        if op == "+" and a.kind == b.kind == "string":
            return Value(F.concat(a.column, b.column), "string", a.error | b.error)
        (x, ex), (y, ey) = _number(a), _number(b)
        made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}.get(op)
        if made:
            out = made(x, y)
        elif a.kind == b.kind == "int":
            out = F.when(y != 0, F.floor(F.abs(x) / F.abs(y)) * F.signum(x.cast("double")) * F.signum(y.cast("double"))).cast("bigint")
        else:
            out = F.try_divide(x, y)
        kind = "int" if a.kind == b.kind == "int" else "float"
        return Value(out, kind, ex | ey | out.isNull())
    if op == "call":
        return _call(tree[1], [_compile(x, look) for x in tree[2]], tree[2])
    return _compare(op, _compile(tree[1], look), _compile(tree[2], look))


def _truth(v: Value) -> Value:
    if v.kind == "bool":
        return Value(F.coalesce(v.column, F.lit(False)), "bool", v.error)
    if v.kind == "any":
        b = F.when(F.schema_of_variant(v.column) == "BOOLEAN", F.try_variant_get(v.column, "$", "boolean"))
        return Value(F.coalesce(b, F.lit(False)), "bool", v.error | b.isNull())
    raise ValueError("a condition must be true or false")


def _text_of(v: Value) -> Column:
    """v's text if it is text."""
    if v.kind == "any":
        return F.when(F.schema_of_variant(v.column) == "STRING", F.try_variant_get(v.column, "$", "string"))
    return v.column if v.kind == "string" else F.lit(None).cast("string")


def _missing(v: Value) -> Column:
    if v.kind == "any":
        return v.column.isNull() | F.coalesce(F.is_variant_null(v.column), F.lit(False))
    return v.column.isNull()


def _compare(sign: str, a: Value, b: Value) -> Value:
    error = a.error | b.error
    numeric = ("int", "float", "any")
    if "nil" in (a.kind, b.kind):
        equal = _missing(a) & _missing(b)
        less = F.lit(False)
    elif a.kind == b.kind and a.kind != "any":
        equal, less = a.column == b.column, a.column < b.column
    else:
        texts = (_text_of(a), _text_of(b))
        (x, _), (y, _) = (_number(v) if v.kind in numeric else (F.lit(None).cast("bigint"), None) for v in (a, b))
        truths = [F.when(F.schema_of_variant(v.column) == "BOOLEAN", F.try_variant_get(v.column, "$", "boolean")) if v.kind == "any" else v.column if v.kind == "bool" else F.lit(None).cast("boolean") for v in (a, b)]
        equal = F.coalesce(texts[0] == texts[1], x == y, truths[0] == truths[1])
        less = F.coalesce(texts[0] < texts[1], x < y)
    equal, less = F.coalesce(equal, F.lit(False)), F.coalesce(less, F.lit(False))
    ordered = ~_missing(a) & ~_missing(b)
    if a.kind != b.kind and "any" in (a.kind, b.kind):
        same = F.coalesce((_text_of(a).isNotNull() & _text_of(b).isNotNull()), F.lit(False))
        if a.kind in numeric and b.kind in numeric:
            same = same | (_number(a)[0].isNotNull() & _number(b)[0].isNotNull())
        ordered = ordered & same
    out = {"==": equal, "!=": ~equal, "<": less, "<=": less | equal, ">": ordered & ~less & ~equal, ">=": ordered & ~less}[sign]
    return Value(F.coalesce(out, F.lit(False)), "bool", error)


def _call(name: str, given: list[Value], trees: list) -> Value:
    v = given[0]
    false = F.lit(False)
    type_ = F.schema_of_variant(v.column) if v.kind == "any" else None
    if name == "Int":
        if v.kind == "any":
            text = F.when(type_ == "STRING", F.try_variant_get(v.column, "$", "string"))
            n = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
            n = F.coalesce(n, F.when(type_ == "BOOLEAN", F.try_variant_get(v.column, "$", "boolean").cast("bigint")), F.when(type_.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v.column, "$", "double").try_cast("bigint")))
            n = F.when(type_.rlike("^(BIGINT|INT|SMALLINT|TINYINT)$"), F.try_variant_get(v.column, "$", "bigint")).otherwise(n)
            return Value(n, "int", v.error | F.coalesce(type_.rlike("^(OBJECT|ARRAY|BINARY)"), false))
        if v.kind == "string":
            return Value(F.when(v.column.rlike("^[+-]?[0-9]+$"), v.column.try_cast("bigint")), "int", v.error)
        return Value(v.column.try_cast("bigint"), "int", v.error)
    if name == "Double":
        n, e = _number(v) if v.kind != "string" else (v.column.try_cast("double"), v.error)
        if v.kind == "any":
            n = F.coalesce(n.cast("double"), F.when(type_ == "STRING", F.try_variant_get(v.column, "$", "string").try_cast("double")))
            e = v.error | F.coalesce(type_.rlike("^(OBJECT|ARRAY|BINARY)"), false)
        return Value(n.cast("double"), "float", e)
    if name == "String":
        return Value(F.try_variant_get(v.column, "$", "string") if v.kind == "any" else v.column.cast("string"), "string", v.error)
    if name == "IsMatch":
        text = F.try_variant_get(v.column, "$", "string") if v.kind == "any" else v.column.cast("string")
        return Value(F.coalesce(text.rlike(trees[1][1]), false), "bool", v.error)
    if name in ("IsMap", "IsList"):
        return Value(F.coalesce(type_.rlike("^OBJECT" if name == "IsMap" else "^ARRAY"), false) if v.kind == "any" else false, "bool", v.error)
    if name == "Abs":
        n, e = _number(v)
        return Value(F.abs(n), "int" if v.kind == "int" else "float", e | n.isNull())
    if name in UNITS or name.startswith("Unix"):
        n, e = _number(v)
        if name == "Unix":
            return Value(F.try_multiply(n.cast("bigint"), F.lit(UNITS["Seconds"]).cast("bigint")), "int", e | n.isNull())
        by = UNITS[name] if name in UNITS else UNITS[name.replace("Unix", "").replace("Nano", "Nanoseconds").replace("Micro", "Microseconds").replace("Milli", "Milliseconds")]
        return Value(F.floor(n.cast("bigint") / by).cast("bigint") if by > 1 else n.cast("bigint"), "int", e | n.isNull())
    if name in ("IsString", "IsInt", "IsBool", "IsDouble"):
        want = {"IsString": ("string", "^STRING$"), "IsInt": ("int", "^(BIGINT|INT|SMALLINT|TINYINT)$"), "IsBool": ("bool", "^BOOLEAN$"), "IsDouble": ("float", "^(DOUBLE|FLOAT|DECIMAL)")}[name]
        return Value(F.coalesce(type_.rlike(want[1]), false) if v.kind == "any" else F.lit(v.kind == want[0]) & v.column.isNotNull(), "bool", v.error)
    text = _text_of(v)
    if name == "Len":
        return Value(F.length(text).cast("bigint"), "int", v.error | F.coalesce(text.isNull() & ~_missing(v), false))
    wrong = v.error | F.coalesce(text.isNull() & ~_missing(v), false)
    if name in OF_TEXT:
        made, kind = OF_TEXT[name]
        return Value(made(text), kind, wrong)
    if name == "ConvertCase":
        return Value((F.lower if trees[1][1] == "lower" else F.upper)(text), "string", wrong)
    if name == "Substring":
        start, size = trees[1][1], trees[2][1]
        return Value(F.substring(text, start + 1, size), "string", wrong | F.coalesce(F.length(text) < start + size, false) | F.lit(start < 0 or size <= 0))
    if name in ("HasPrefix", "HasSuffix", "Index"):
        other = _text_of(given[1])
        wrong = wrong | given[1].error | F.coalesce(other.isNull() & ~_missing(given[1]), false)
        if name == "Index":
            return Value((F.call_function("locate", other, text) - 1).cast("bigint"), "int", wrong)
        return Value(F.coalesce(F.startswith(text, other) if name == "HasPrefix" else F.endswith(text, other), false), "bool", wrong)
    return Value(F.concat(F.coalesce(text, F.lit("")), F.coalesce(_text_of(given[1]), F.lit(""))), "string", v.error | given[1].error)


@dataclasses.dataclass(frozen=True)
class Condition:
    text: str
    tree: tuple

    def columns(self, look: Lookup) -> tuple[Column, Column]:
        """(matched, failed); what failed doesn't match."""
        v = _truth(_compile(self.tree, look))
        failed = F.coalesce(v.error, F.lit(False))
        return F.coalesce(v.column, F.lit(False)) & ~failed, failed


def compile_condition(text: str) -> Condition:
    """Raises ValueError for what isn't a condition."""
    tree = _Parser(text).whole()
    if tree[0] in ("literal", "+", "-", "*", "/") and not isinstance(tree[1], bool) or tree[0] == "field":
        raise ValueError("a condition must be true or false")
    return Condition(text, tree)
