"""Models behind one shape: a provider is a function from a pandas batch to a pandas batch, run by mapInPandas.

Separation, speech and speaker detection, recognition, embeddings and language models are not part of this library; a
user hands in a factory that builds the model once a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Provider = Callable[[pd.DataFrame], pd.DataFrame]


def provide(rows: DataFrame, factory: Callable[[], Provider], schema: str, key: str, size: int = 64) -> DataFrame:
    """The provider's rows with the columns of ``schema`` and ``key``, and an ``error`` row for each input row that fails alone.

    Batches hold at most ``size`` rows. A batch that fails is retried row by row, so one bad row takes no other with it.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for whole in batches:
            for at in range(0, len(whole), size):
                pdf = whole.iloc[at : at + size]
                try:
                    yield model(pdf).assign(error=None)[[key, *names, "error"]]
                except Exception:  # noqa: BLE001  any failure of a model is data here
                    for i in range(len(pdf)):
                        one = pdf.iloc[i : i + 1]
                        try:
                            yield model(one).assign(error=None)[[key, *names, "error"]]
                        except Exception as e:  # noqa: BLE001
                            yield pd.DataFrame([{key: one[key].iloc[0], **dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"}])

    return rows.mapInPandas(run, f"{key} {kind}, {schema}, error string")
