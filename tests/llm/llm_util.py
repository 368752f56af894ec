import re

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels", "conversations", "benchmark")


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def duck(sql, **tables):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, arrow in tables.items():
        con.register(name + "_arrow", arrow)
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {name}_arrow")
    r = con.execute(sql)
    return [x[0] for x in r.description], r.fetchall()


def same(df, sql, **tables):
    cols, rows = duck(sql, **tables)
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in df.columns]
    key = lambda r: tuple(repr(x) for x in r)
    got = sorted((tuple(r) for r in df.collect()), key=key)
    assert got == sorted((tuple(r[i] for i in order) for r in rows), key=key)
    return got


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
