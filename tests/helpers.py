"""Helpers of several test modules."""


def by_user(df, *columns):
    """{user_id: row or tuple of columns} of a frame with one row per user."""
    rows = df.collect()
    return {r["user_id"]: tuple(r[c] for c in columns) if columns else r for r in rows}
