"""How tests compare tables."""

import math


def canonical(frame):
    """Rows as sorted tuples of plain values, columns by name."""

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return None
        if hasattr(v, "isoformat"):
            return str(v)[:19].removesuffix(" 00:00:00")
        if hasattr(v, "item"):
            v = v.item()
        return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    names = sorted(frame.columns)
    return names, sorted((tuple(plain(v) for v in row) for row in frame[names].astype(object).itertuples(index=False)), key=str)
