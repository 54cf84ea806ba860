"""Where the tables are, and the comparison of queries with SQL."""

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows, columns):
    """Rows with columns by name, as text, in order."""

    def cell(x):
        if x is None or x != x:
            return "NULL"
        if isinstance(x, float):
            return f"{x + 0.0:.5f}"
        return str(x)

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def same_as_sql(spark, duck, query, sql):
    df = query(spark, SF)
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(found.fetchall(), names)
