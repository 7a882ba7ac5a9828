"""PostScript-style calculator programs, compiled to column expressions.

A program is parsed once on the driver. The compiler then runs it on a stack
of columns instead of numbers: arithmetic becomes expressions inside Spark's
code generation, conditionals merge the two stacks slot by slot, and counts of
``copy`` and ``roll`` must be constants. Errors of a row (division by zero,
root of a negative number, a result that is not finite) do not fail the job;
they are the ``error`` of the row's result. A program whose branches leave
stacks of different depth, or whose counts come from data, runs in the
row interpreter instead (an Arrow-batched UDF with the same semantics).

Values are doubles; comparison and logic yield 1.0 or 0.0; a block sees a copy
of the stack and its result replaces the stack. ``}`` only marks an end: what
follows a block goes into it until ``if`` or ``ifelse`` takes the block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The operator words.
WORDS = ("add", "sub", "mul", "div", "dup", "exch", "pop", "eq", "ne", "gt", "lt", "ge", "le", "and", "or", "not", "copy", "roll", "sqrt", "cvi", "mod", "truncate", "abs")


class CalculatorError(ValueError):
    """An error with a stable ``kind``."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


class NotCompilable(Exception):
    """The program's stack depends on data."""


@dataclass(frozen=True)
class Branch:
    """``if`` (no else) or ``ifelse``."""

    then: tuple
    other: tuple | None


def parse(text: str) -> tuple:
    """The program as numbers, words and branches."""
    open_blocks: list[list] = [[]]

    def take(kind: str) -> tuple:
        if not open_blocks:
            raise CalculatorError(kind)
        return tuple(open_blocks.pop())

    for token in text.replace("{", " { ").replace("}", " } ").split():
        if token == "{":
            open_blocks.append([])
            continue
        if token == "}":
            continue
        if token == "if":
            item = Branch(take("MissingIfBlock"), None)
        elif token == "ifelse":
            other = take("MissingIfElseBlocks")
            item = Branch(take("MissingIfElseBlocks"), other)
        elif token in WORDS:
            item = token
        elif token in ("true", "false"):
            item = float(token == "true")
        else:
            item = _number(token)
        if not open_blocks:
            raise CalculatorError("EmptyBlockStack")
        open_blocks[-1].append(item)
    return take("EmptyBlockStack")


def _number(token: str) -> float:
    try:
        if "_" in token:
            raise ValueError
        return float(token)
    except ValueError:
        raise CalculatorError("InvalidNumber", token) from None


def run(program: tuple, stack: Iterable[float]) -> list[float]:
    """The row interpreter: the final stack, bottom first."""
    stack = [float(x) for x in stack]

    def pop() -> float:
        if not stack:
            raise CalculatorError("StackUnderflow")
        return stack.pop()

    def push(x: float) -> None:
        if not math.isfinite(x):
            raise CalculatorError("ArithmeticOverflow")
        stack.append(x)

    for item in program:
        if isinstance(item, float):
            push(item)
        elif isinstance(item, Branch):
            block = item.then if pop() != 0 else item.other
            if block is not None:
                stack[:] = run(block, stack)
        elif item == "pop":
            pop()
        elif item == "dup":
            if not stack:
                raise CalculatorError("StackUnderflow")
            push(stack[-1])
        elif item == "exch":
            b, a = pop(), pop()
            push(b)
            push(a)
        elif item == "copy":
            n = _count(pop(), "copy")
            if n > len(stack):
                raise CalculatorError("ArithmeticOverflow", "copy_index")
            stack.extend(stack[len(stack) - n :])
        elif item == "roll":
            by, n = pop(), _count_first(pop)
            if not math.isfinite(by):
                raise CalculatorError("NegativeIntegerOperand", "roll")
            if n > len(stack):
                raise CalculatorError("RollCountTooLarge")
            _rotate(stack, n, int(by))
        elif item in _UNARY:
            push(_UNARY[item](pop()))
        else:
            b = pop()
            if item in ("div", "mod") and b == 0:
                raise CalculatorError("DivisionByZero")
            push(_BINARY[item](pop(), b))
    return stack


def _count(value: float, op: str) -> int:
    if value < 0 and value > -1:
        return 0
    if value < 0:
        raise CalculatorError("InvalidIntegerOperand", op)
    return int(value)


def _count_first(pop) -> int:
    return _count(pop(), "roll")


def _rotate(stack: list, n: int, by: int) -> None:
    if n:
        by %= n
        top = stack[len(stack) - n :]
        stack[len(stack) - n :] = top[n - by :] + top[: n - by]


def _root(a: float) -> float:
    if a < 0:
        raise CalculatorError("NegativeSqrt")
    return math.sqrt(a)


def _safe(f):
    def g(a: float, b: float) -> float:
        try:
            return f(a, b)
        except OverflowError:
            return math.inf

    return g


_UNARY = {"not": lambda a: float(a == 0), "sqrt": _root, "cvi": lambda a: float(math.trunc(a)), "truncate": lambda a: float(math.trunc(a)), "abs": abs}
_BINARY = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": _safe(lambda a, b: a / b),
    "mod": math.fmod,
    "eq": lambda a, b: float(a == b),
    "ne": lambda a, b: float(a != b),
    "gt": lambda a, b: float(a > b),
    "lt": lambda a, b: float(a < b),
    "ge": lambda a, b: float(a >= b),
    "le": lambda a, b: float(a <= b),
    "and": lambda a, b: float(a != 0 and b != 0),
    "or": lambda a, b: float(a != 0 or b != 0),
}


@dataclass
class _Slot:
    """A stack slot: its column and, where known, its constant value."""

    column: Column
    constant: float | None = None


class _Compiler:
    def __init__(self) -> None:
        self.errors: list[tuple[Column, str]] = []

    def compile(self, program: tuple, stack: list[_Slot], when: Column | None) -> list[_Slot]:
        stack = list(stack)

        def fail(condition: Column, kind: str) -> None:
            self.errors.append((condition if when is None else when & condition, kind))

        def pop() -> _Slot:
            if not stack:
                raise CalculatorError("StackUnderflow")
            return stack.pop()

        def constant(slot: _Slot) -> float:
            if slot.constant is None:
                raise NotCompilable("a count comes from data")
            return slot.constant

        def push(column: Column, check: bool = False) -> None:
            if check:
                # NaN is above infinity here, so this finds both and names the column once.
                fail(~(F.abs(column) < float("inf")), "ArithmeticOverflow")
            stack.append(_Slot(column))

        for item in program:
            if isinstance(item, float):
                if not math.isfinite(item):
                    raise CalculatorError("ArithmeticOverflow")
                stack.append(_Slot(F.lit(item), item))
            elif isinstance(item, Branch):
                test = pop()
                if test.constant is not None:
                    block = item.then if test.constant != 0 else item.other
                    stack = stack if block is None else self.compile(block, stack, when)
                    continue
                yes = test.column != 0
                no = ~yes
                then = self.compile(item.then, stack, yes if when is None else when & yes)
                other = stack if item.other is None else self.compile(item.other, stack, no if when is None else when & no)
                if len(then) != len(other):
                    raise NotCompilable("branches leave stacks of different depth")
                stack = [a if a is b else _Slot(F.when(yes, a.column).otherwise(b.column)) for a, b in zip(then, other, strict=True)]
            elif item == "pop":
                pop()
            elif item == "dup":
                top = pop()
                stack += [top, top]
            elif item == "exch":
                b, a = pop(), pop()
                stack += [b, a]
            elif item == "copy":
                n = _count(constant(pop()), "copy")
                if n > len(stack):
                    raise CalculatorError("ArithmeticOverflow", "copy_index")
                stack += stack[len(stack) - n :]
            elif item == "roll":
                by = int(constant(pop()))
                n = _count(constant(pop()), "roll")
                if n > len(stack):
                    raise CalculatorError("RollCountTooLarge")
                _rotate(stack, n, by)
            elif item in ("cvi", "truncate"):
                a = pop().column
                push(F.when(a < 0, F.ceil(a)).otherwise(F.floor(a)).cast("double"))
            elif item == "abs":
                push(F.abs(pop().column))
            elif item == "not":
                push(_flag(pop().column == 0))
            elif item == "sqrt":
                a = pop().column
                fail(a < 0, "NegativeSqrt")
                push(F.sqrt(a))
            else:
                b, a = pop().column, pop().column
                if item == "div":
                    fail(b == 0, "DivisionByZero")
                    push(F.try_divide(a, b), check=True)
                elif item == "mod":
                    fail(b == 0, "DivisionByZero")
                    push(F.try_mod(a, b))
                elif item in ("add", "sub", "mul"):
                    push({"add": a + b, "sub": a - b, "mul": a * b}[item], check=True)
                else:
                    logic = {"eq": a == b, "ne": a != b, "gt": a > b, "lt": a < b, "ge": a >= b, "le": a <= b, "and": (a != 0) & (b != 0), "or": (a != 0) | (b != 0)}
                    push(_flag(logic[item]))
        return stack


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


RESULT = T.StructType([T.StructField("stack", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])


def compiled(text: str, inputs: Sequence[Column | str]) -> tuple[list[Column], list[tuple[Column, str]]]:
    """The final stack's columns (bottom first) and (condition, kind) of the errors, first ones first; raises NotCompilable."""
    slots = [_Slot((F.col(c) if isinstance(c, str) else c).cast("double")) for c in inputs]
    compiler = _Compiler()
    stack = compiler.compile(parse(text), slots, None)
    errors: list[tuple[Column, str]] = []
    for condition, kind in compiler.errors:
        if errors and errors[-1][1] == kind:
            errors[-1] = (errors[-1][0] | condition, kind)
        else:
            errors.append((condition, kind))
    return [s.column for s in stack], errors


def outcome(errors: Sequence[tuple[Column, str]], failed: Callable[[str], Column], good: Column) -> Column:
    """``failed`` of the first error whose condition holds, else ``good``.

    One CASE in which each condition stands once: an error column that is looked at for every field
    multiplies the generated code, and methods of over 8,000 bytes are never compiled to machine code.
    """
    if not errors:
        return good
    (condition, kind), *others = errors
    found = F.when(condition, failed(kind))
    for condition, kind in others:
        found = found.when(condition, failed(kind))
    return found.otherwise(good)


def evaluate(text: str, inputs: Sequence[Column | str]) -> Column:
    """STRUCT<stack ARRAY<DOUBLE>, error STRING> of the program on each row's inputs.

    An error of the program itself is every row's error. A null input gives a
    null stack and no error.
    """
    columns = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in inputs]
    try:
        stack, errors = compiled(text, inputs)
        body = F.array(*stack) if stack else F.array().cast("array<double>")
    except CalculatorError as e:
        return F.struct(F.lit(None).cast("array<double>").alias("stack"), F.lit(e.kind).alias("error"))
    except NotCompilable:
        return interpreted(text)(F.array(*columns)) if columns else interpreted(text)(F.array().cast("array<double>"))
    known = F.lit(True)
    for c in columns:
        known = known & c.isNotNull()
    return F.when(~known, _result(None, None)).otherwise(outcome(errors, lambda kind: _result(None, kind), _result(body, None)))


def _result(stack: Column | None, error: str | None) -> Column:
    return F.struct((F.lit(None).cast("array<double>") if stack is None else stack).alias("stack"), F.lit(error).cast("string").alias("error"))


def interpreted(text: str):
    """The same as a UDF over ARRAY<DOUBLE>, one Python call per row, batched by Arrow."""
    program = parse(text)

    @F.udf(returnType=RESULT, useArrow=True)
    def apply(stack):
        if stack is None or any(x is None for x in stack):
            return (None, None)
        try:
            return (run(program, stack), None)
        except CalculatorError as e:
            return (None, e.kind)

    return apply
