def rows_of(frame):
    """Rows as sorted tuples of text, columns by name; floats to nine digits."""
    import pandas as pd

    def text(v):
        if pd.isna(v):
            return "null"
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v):.9g}"
        return str(v)

    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))
