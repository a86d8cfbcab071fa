"""Small pieces of Arrow batches, so that a task's Python objects stay few."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd


def pieces(batches: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    """The batches' rows, ``rows`` at a time."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.iloc[k : k + rows]
