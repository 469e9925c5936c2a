"""Rows of two engines side by side."""


def plain(x):
    """A value as text that compares equal across engines."""
    if x is None or x != x:
        return "null"
    if isinstance(x, (bool,)) or type(x).__name__ == "bool_":
        return str(bool(x)).lower()
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, float) or type(x).__name__.startswith("float"):
        return str(int(x)) if float(x).is_integer() else f"{float(x):.6g}"
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in x.items()) + "}"
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return "[" + ",".join(plain(v) for v in x) + "]"
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(df, con, sql):
    """None if both have the same columns and rows, else what differs first."""
    answer = con.execute(sql)
    theirs = rows([c[0] for c in answer.description], answer.fetchall())
    ours = rows(df.columns, df.collect())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} and {len(theirs[1])} rows"
    return next((f"{a} and {b}" for a, b in zip(ours[1], theirs[1], strict=True) if a != b), None)
