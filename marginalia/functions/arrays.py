"""Array expressions for per-file work that must not leave the row.

They are written as SQL text: one parse per expression, where the same tree built
from Python lambdas would take a call into the JVM for every node.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 32


def let(value: Column, function: str) -> Column:
    """Apply the SQL lambda ``function`` to ``value``, which is evaluated once."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(function)), 1)


def let_sql(name: str, value: str, body: str) -> str:
    """SQL text of ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def literal(text: str) -> str:
    """SQL text of a string, whatever characters it has."""
    return "decode(unhex('" + text.encode().hex() + "'), 'UTF-8')"


def running_sum_sql(values: str, zero: str, levels: int = 2) -> str:
    """SQL text of an array with the sum of all earlier elements for every element of ``values``.

    Arrays are immutable, so adding one total at a time copies the array each time.
    Long arrays are therefore summed in blocks of 32, the block totals the same way,
    and the two added: a text with a million pieces costs some 16 copied elements
    per piece instead of half a million.
    """

    def sums(items: str) -> str:
        """0, a, a + b, ... with the grand total last."""
        return f"reverse(aggregate({items}, array({zero}), (done, value) -> array_prepend(done, done[0] + value)))"

    items, blocks = f"items{levels}", f"blocks{levels}"
    direct = f"slice({sums(items)}, 1, size({items}))"
    if levels == 0:
        return let_sql(items, values, direct)
    bases = running_sum_sql(f"transform({blocks}, block -> element_at(block, -1))", zero, levels - 1)
    blocked = let_sql(
        blocks,
        f"transform(sequence(1, size({items}), {_BLOCK}), at -> {sums(f'slice({items}, at, {_BLOCK})')})",
        f"flatten(zip_with({blocks}, {bases}, "
        "(block, base) -> transform(slice(block, 1, size(block) - 1), value -> value + base)))",
    )
    return let_sql(items, values, f"if(size({items}) <= {_BLOCK}, {direct}, {blocked})")
