"""The adaptive low-pass on a stream: the batch operator's step with its state by series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinespark.operators.temporal import one_euro_step


def one_euro_stream(df: DataFrame, keys: list[str], clock: str, values: list[str], identity: str, **how: float) -> DataFrame:
    """temporal.one_euro() on a stream. Within a batch frames go by `clock`; a frame that comes
    after later ones of its series starts the filter anew, as a gap does."""
    columns = [*keys, clock, identity, *values]

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = None
        if held.exists:
            t, name, *parts = held.get
            state = (t, name, *(np.array([p]) for p in parts), None)
        frame = pd.concat(list(frames)).sort_values(clock)
        out = []
        for t, name, *x in frame[[clock, identity, *values]].itertuples(index=False):
            state = one_euro_step(state, int(t), np.array([x], float), name, **how)
            out.append((*key, t, name, *state[3][0]))
        held.update((state[0], state[1], *(p[0].tolist() for p in state[2:5])))
        yield pd.DataFrame(out, columns=columns)

    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {'double' if c in values else kind[c]}" for c in columns)
    state = "t long, identity string, raw array<double>, filtered array<double>, slope array<double>"
    return df.groupBy(*keys).applyInPandasWithState(update, schema, state, "append", GroupStateTimeout.NoTimeout)
