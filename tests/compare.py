"""Rows of a DataFrame and of a DuckDB relation in one comparable form."""


def _cell(v):
    if v is None or v != v:
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return float(v) if isinstance(v, float | int) and not isinstance(v, bool) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_cell(r[i]) for i in order) for r in values), key=repr)


def of_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_duck(con, sql):
    out = con.execute(sql)
    return rows([c[0] for c in out.description], out.fetchall())
