"""Comparing a query with its SQL."""


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(9)
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).astype(str).values.tolist()))


def agree(spark, sf, duck, query, sql):
    ours, theirs = query(spark, sf).toPandas(), duck.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    assert normal(ours) == normal(theirs)
