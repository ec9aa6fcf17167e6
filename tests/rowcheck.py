"""Row comparison for the tests; a module of its own, so that no other conftest hides it."""


def same_rows(a, b, digits=9):
    """Both DataFrames hold the same rows, floats compared to `digits`."""
    def norm(df):
        cols = sorted(df.columns)
        fix = lambda v: round(v, digits) + 0.0 if isinstance(v, float) else v
        return sorted((tuple(str(fix(v)) for v in r) for r in df.select(*cols).collect()))

    x, y = norm(a), norm(b)
    assert len(x) == len(y)
    for p, q in zip(x, y):
        assert p == q
