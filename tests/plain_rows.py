"""Results as plain values, for comparing in tests."""


def rows(df):
    """Sorted plain tuples."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(repr, r)))
