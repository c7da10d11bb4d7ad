"""A hook that corrects triples in batches, such as a model would.

``normalizer(correct)`` gives a function for ``Repository.ingest``. ``correct`` gets a list
of dictionaries with the fields below and returns such a list. A batch that raises is
tried again; after the last try, and for every row that comes back malformed or not at
all, the rows stay as they were. No other field can change, and no row is added or lost.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

FIELDS = ("from_entity", "from_type", "relation_type", "to_entity", "to_type")
BATCH, RETRIES = 75, 2


def corrected(rows: list[dict], correct: Callable[[list[dict]], list], retries: int = RETRIES) -> list[dict]:
    """The rows of one batch, as far as they could be corrected."""
    for _ in range(retries + 1):
        try:
            answer = correct([dict(r) for r in rows])
        except Exception:  # whatever a model does must not end a run
            continue
        if isinstance(answer, list):
            given = answer + [None] * len(rows)
            usable = lambda new: isinstance(new, dict) and all(isinstance(new.get(f, ""), str) for f in FIELDS)
            return [r | {f: new[f] for f in FIELDS if f in new} if usable(new) else r for r, new in zip(rows, given, strict=False)]
    return rows


def normalizer(correct: Callable[[list[dict]], list], batch: int = BATCH, retries: int = RETRIES) -> Callable[[DataFrame], DataFrame]:
    def run(triples: DataFrame) -> DataFrame:
        def change(frames):
            for frame in frames:
                for at in range(0, len(frame), batch):
                    part = frame.iloc[at : at + batch].copy()
                    new = corrected(part[list(FIELDS)].to_dict("records"), correct, retries)
                    part[list(FIELDS)] = pd.DataFrame(new, columns=list(FIELDS)).values
                    yield part

        return triples.mapInPandas(change, triples.schema)

    return run
