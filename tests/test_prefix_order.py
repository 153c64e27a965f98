"""Prefix merges against the turns they stand for, name by name."""

import random

from narrata.operators import resolve


def by_turns(names):
    """{position: position}: each name in its turn against all later ones, as names that have merged allow."""
    words, gone = [x.split() for x in names], {}
    for i, a in enumerate(words):
        if i in gone:
            continue
        for j in range(i + 1, len(words)):
            b = words[j]
            few, many = sorted((len(a), len(b)))
            if j in gone or a[0] != b[0] or not (few == 1 < many or few > 1 and a[-1] == b[-1]):
                continue
            if len(b) < len(a):
                gone[j] = i
            else:
                gone[i] = j
    return gone


def test_prefixes_by_turns(spark):
    rnd = random.Random(3)
    stories = {f"s{k}": [" ".join([rnd.choice(["ada", "bea"])] + rnd.choices("klm", k=rnd.choice([0, 0, 1, 2, 3, 4]))) for _ in range(rnd.randrange(1, 14))] for k in range(150)}
    rows = [(s, f"{s}-{i}", i, "Character", x) for s, names in stories.items() for i, x in enumerate(names)]
    rnd.shuffle(rows)
    got = {(r.story_id, r.id): r["into"] for r in resolve.merge_prefixes(spark.createDataFrame(rows, "story_id string, id string, pos int, type string, name string")).collect()}
    assert got == {(s, f"{s}-{i}"): f"{s}-{j}" for s, names in stories.items() for i, j in by_turns(names).items()}


def test_many_names_of_one_head(spark):
    """No pairs: 20,000 names that begin alike, of which half have one token, would be 10**8."""
    n = spark.range(20000).selectExpr("'s' as story_id", "cast(id as string) as id", "id as pos", "'Character' as type", "case when id % 2 = 0 then 'ada' else concat('ada n', id) end as name")
    got = {int(r.id): int(r["into"]) for r in resolve.merge_prefixes(n).collect()}
    assert got == {i: 1 if i else 19999 for i in range(0, 20000, 2)}


def test_names_of_their_own(spark, tmp_path):
    """The query's fuller names differ by their keys, also where customers share a name: only short names merge, as in its SQL."""
    import duckdb

    from narrata.plans import catalogue

    spark.range(3000).selectExpr("id as c_custkey", "concat('Customer#', id % 300) as c_name", "cast(id % 2 as int) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = duck.sql(catalogue.oracle_sql()["prefix_merge"]).fetchall()
    assert sorted(map(tuple, catalogue.queries()["prefix_merge"](spark, str(tmp_path)).collect())) == sorted(want)
