"""Order-free comparison of results by rows of text, doubles to nine digits."""

import numpy as np
import pandas as pd


def _text(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and v != v):
        return "~"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(_text, v)) + "]"
    if isinstance(v, (float, np.floating)):
        return "%.9g" % (0.0 if v == 0 else v)
    return str(v)


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    return sorted("|".join(map(_text, r)) for r in df.itertuples(index=False))
