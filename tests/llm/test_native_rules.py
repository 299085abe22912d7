import re
from collections import Counter

import duckdb
import pytest
from conftest import MEDIUM, SMALL

from churnlens.llm import mixing, rules
from llm.cases import TEXTS, awkward, none

KEY = lambda x: tuple((v is None, v) for v in x)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_sql(spark, docs, sql, folder):
    docs.coalesce(1).write.mode("overwrite").parquet(folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    out = con.execute(sql)
    return [c[0] for c in out.description], out.fetchall()


@pytest.mark.parametrize(("run", "sql"), [(rules.quality_rules, rules.SQL), (mixing.mix, mixing.SQL)])
def test_awkward_rows_as_in_sql(spark, tmp_path, run, sql):
    for docs in (awkward(spark), none(spark)):
        names, want = by_sql(spark, docs, sql, f"{tmp_path}/d")
        got = [tuple(r) for r in run(docs).select(*names).collect()]
        assert sorted(got, key=KEY) == sorted(want, key=KEY)


def test_counts_of_repeats(spark):
    texts = ["a b c d e f g h " * 3, "a b c d e f g h x a b c d e f g h", "one\n two \none\n\n \none", " ".join(str(i) for i in range(50)), "w " * 100]
    got = {r["doc_id"]: r for r in rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(t)
        wins = [tuple(words[j : j + 8]) for j in range(len(words) - 7)]
        times = Counter(wins)
        covered = {k for j, w in enumerate(wins) if times[w] > 1 for k in range(j, j + 8)}
        assert got[i]["n_repeat_words"] == len(covered)
    assert got[2]["n_dup_lines"] == 2


def test_clean_prose_stays_and_junk_goes(spark):
    prose = "The weather was fine and they went out to see it. Nobody had said a word about the rain, which came later.\n" * 1
    rows = [(0, prose), (1, " | ".join(["home", "news", "shop", "help"] * 8)), (2, "LOOK!! HERE!! NOW!! " * 9), (3, " ".join(f"w{i}$$$" for i in range(40))), (4, prose + "All rights reserved."), (5, "short text.")]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "verdict.*").collect()}
    assert {i: got[i]["kept"] for i in got} == {0: True, 1: False, 2: False, 3: False, 4: True, 5: False}
    assert got[4]["clean_text"] == prose.strip()


def test_mix_meets_targets(spark):
    got = mixing.mix(spark.read.parquet(f"{MEDIUM}/documents.parquet")).collect()
    docs = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[docs[r["doc_id"]]] += r["taken"]
        size[docs[r["doc_id"]]] += r["size"]
        target[docs[r["doc_id"]]] = r["target"]
    total = sum(size.values())
    assert abs(sum(target.values()) - 1.5 * total) < 1
    names = sorted(target)
    level = max(target[s] / (5, 2, 1)[i % 3] for i, s in enumerate(names))
    for i, s in enumerate(names):
        assert abs(taken[s] - target[s]) <= 1
        assert abs(target[s] - min(2 * size[s], level * (5, 2, 1)[i % 3])) < 1e-3
    again = mixing.mix(spark.read.parquet(f"{MEDIUM}/documents.parquet").repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_running_sums_over_parts(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else "k", i % 7, i, 1) for i in range(100)], "g string, part int, i int, v int")
    got = mixing.running(df, ["g"], "part", [df["i"]], "v", "before").collect()
    for g in (None, "k"):
        own = sorted((r["part"], r["i"], r["before"]) for r in got if r["g"] == g)
        assert [x[2] for x in own] == list(range(len(own)))


def test_native_plans_hold_no_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for df in (rules.quality_rules(docs), mixing.mix(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
    assert len(TEXTS) > 5
