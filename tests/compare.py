"""Rows of frames in one comparable form."""

from __future__ import annotations


def _cell(v) -> str:
    import pandas as pd

    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return repr(int(v)) if v == int(v) else repr(round(v, 9))
    return str(v)


def rows_of(frame) -> list[tuple[str, ...]]:
    """Sorted rows of a pandas frame, columns by name."""
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_cell, r)) for r in frame.itertuples(index=False))
