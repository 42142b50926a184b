"""Order-insensitive comparison of a Spark result with an oracle's."""

import math


def canonical(rows, columns):
    def value(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return repr(x)
        if isinstance(x, (list, tuple)):
            return repr([value(y) for y in x])
        x = float(x)
        return "None" if math.isnan(x) else repr(round(x, 6) + 0.0)

    return sorted(tuple(value(r[c]) for c in columns) for r in rows)


def same(spark_df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(spark_df.columns)
    columns = sorted(names)
    want = canonical([dict(zip(names, r, strict=True)) for r in cur.fetchall()], columns)
    got = canonical([r.asDict() for r in spark_df.collect()], columns)
    assert len(got) == len(want)
    assert got == want
