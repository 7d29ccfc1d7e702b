"""Rows of two results in a common form."""


def plain(value):
    if value is None or value != value:
        return "∅"
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows(names, table):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in table)


def assert_same(df, sql, oracle):
    relation = oracle.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(relation.columns, relation.fetchall())
