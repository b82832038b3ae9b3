"""Comparison of two tables of rows, whatever their order and the order of their columns."""

import math


def cell(x):
    """A value that sorts and compares: floats apart, everything else as text."""
    if isinstance(x, float):
        return "0" if x == 0 else f"{x:.9e}"
    if isinstance(x, (list, tuple)):
        return str([cell(y) for y in x])
    return str(x)


def same(columns, rows, other_columns, other_rows):
    """None if the tables agree, floats to 1e-9 of their size; else what differs first."""
    if sorted(columns) != sorted(other_columns):
        return f"columns {sorted(columns)} and {sorted(other_columns)}"
    if len(rows) != len(other_rows):
        return f"{len(rows)} and {len(other_rows)} rows"
    order, other = (sorted(range(len(c)), key=lambda i: c[i]) for c in (columns, other_columns))
    exact = lambda r: tuple("" if isinstance(x, float) else cell(x) for x in r)
    key = lambda r: (exact(r), tuple(x if isinstance(x, float) else 0.0 for x in r))
    a, b = (sorted((tuple(r[i] for i in by) for r in given), key=key) for by, given in ((order, rows), (other, other_rows)))
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            both = isinstance(p, float) or isinstance(q, float)
            if both and p is not None and q is not None and not isinstance(p, str):
                if not math.isclose(float(p), float(q), rel_tol=1e-9, abs_tol=1e-12):
                    return f"{x} and {y}"
            elif cell(p) != cell(q):
                return f"{x} and {y}"
    return None
