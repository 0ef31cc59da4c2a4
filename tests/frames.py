"""Helpers that compare rows of frames."""


def rows(df, *cols):
    """Rows as a sorted list of tuples (nulls first)."""
    out = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))
