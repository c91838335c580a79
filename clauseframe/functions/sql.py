"""Expressions as SQL text: parsed at once, where a tree of Column calls takes a call to the JVM for every node."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRETCH = 64
#: A fold over nothing gives a value a name: only its last step runs, and nothing is copied.
_NONE = "cast(array() AS array<int>)"


def applied(lambda_sql: str, *columns: Column) -> Column:
    """A lambda such as "x -> upper(x)" of a column; of several columns, x is a struct with the fields a, b, c ..."""
    one = columns[0] if len(columns) == 1 else F.struct(*[c.alias(name) for c, name in zip(columns, "abcdef")])
    return F.call_function("aggregate", F.expr(_NONE), one, F.expr("(a, e) -> a"), F.expr(lambda_sql))


def apart(column: Column) -> Column:
    """Keeps a column in a projection of its own: an expression that is folded into the argument of a Python function may stay unevaluated."""
    return F.when(F.spark_partition_id() >= 0, column)


def let(value: str, name: str, body: str) -> str:
    """The body, in which the name stands for the value, that is found once."""
    return f"aggregate({_NONE}, {value}, (a, e) -> a, {name} -> {body})"


def raw(text: str) -> str:
    return f"r'{text}'" if "'" not in text else f'r"{text}"'


def texts(names) -> str:
    return f"array({', '.join(raw(n) for n in names)})" if names else "cast(array() as array<string>)"


def grown(kind: str, rows: str, state: dict[str, str], step: dict[str, str], item: str, add: str = "true", last: str | None = None) -> str:
    """An array made by a fold: for each row x, with the state a, `item` is added where `add` holds, and the state's fields become those of `step`.

    Items are gathered in short stretches, so that an addition doesn't copy all those before it. `last`: an item for the end, or null.
    """
    here, done = f"array<{kind}>", f"array<array<{kind}>>"
    start = ", ".join(f"'{k}', {v}" for k, v in state.items())
    fields = ", ".join(f"'{k}', {v}" for k, v in step.items())
    added = f"'now', if({add}, if(size(a.now) < {STRETCH}, concat(a.now, array({item})), array({item})), a.now), 'done', if(({add}) AND size(a.now) >= {STRETCH}, concat(a.done, array(a.now)), a.done)"
    end = f"flatten(concat(a.done, array(a.now){f', array(array_compact(array({last})))' if last else ''}))"
    return f"aggregate({rows}, named_struct({start}, 'now', cast(array() as {here}), 'done', cast(array() as {done})), (a, x) -> named_struct({fields}, {added}), a -> {end})"


def running(lengths: str) -> str:
    """The sum of all numbers before each."""
    return grown("int", lengths, {"at": "0"}, {"at": "a.at + x"}, "a.at")


def checked(row: T.DataType) -> T.StructType:
    """The type of rows with an error beside them; workers import this too, where a type can't be given as text."""
    return T.StructType([T.StructField("rows", T.ArrayType(row)), T.StructField("error", T.StringType())])


def explained(f):
    """A function of one row that gives (what it finds, null), or (null, the exception's type and message), so that one document doesn't end the job.

    Running out of memory is no fault of a document and does end it.
    """

    def run(*args):
        try:
            return f(*args), None
        except MemoryError:
            raise
        except Exception as e:  # noqa: BLE001 - whatever a document brings, it is an error of that document only
            return None, f"{type(e).__name__}: {e}"

    return run


#: Arguments up to this length are remembered with what was found for them, so many in a worker.
SHORT, REMEMBERED = 64, 20_000
_known: dict = {}


def remembered(f):
    """As explained, for a function of one tuple: many texts have the same short sequence of ordinals or types, which is looked at once."""
    run, known = explained(f), _known.setdefault((f.__module__, f.__qualname__), {})

    def of(items: tuple):
        if len(items) > SHORT:
            return run(items)
        found = known.get(items)
        if found is None:
            if len(known) >= REMEMBERED:
                known.clear()
            found = known[items] = run(items)
        return found

    return of


def rows_with_errors(found, fields: list[tuple[str, pa.DataType]]) -> pa.StructArray:
    """(rows or null, error or null) for each text, as an Arrow column of the type that `checked` gives."""
    sizes, rows, none, errors = [0], [], [], []
    for own, error in found:
        rows += own or ()
        sizes.append(len(rows))
        none.append(own is None)
        errors.append(error)
    columns = list(zip(*rows)) or [()] * len(fields)
    items = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])
    lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items, mask=pa.array(none) if any(none) else None)
    return pa.StructArray.from_arrays([lists, pa.array(errors, pa.string())], ["rows", "error"])


def tried(f):
    """As explained, without the reason: null where it fails."""
    run = explained(f)
    return lambda *args: run(*args)[0]
