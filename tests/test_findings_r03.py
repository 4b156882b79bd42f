"""What the review of round 3 found, on small tables of its own, against the SQL."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from harrow.functions import text
from harrow.operators import joins, portfolio, results
from harrow.plans import registry, studies
from harrow.sources import scratch
from harrow.sources.scratch import written

from . import oracle


@pytest.fixture
def made(tmp_path):
    """Writes a table from SQL and gives the folder and a connection that sees it."""

    def make(**tables):
        for name, sql in tables.items():
            duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        return str(tmp_path), oracle.connect(tmp_path)

    return make


def differs(spark, name, folder, db):
    return oracle.difference(registry.QUERIES[name](spark, folder), db, registry.ORACLE_SQL[name])


def test_d10_seconds_are_rounded_as_in_sql(spark, made):
    at = "(VALUES (1, '2024-01-01 00:00:00.6'), (2, '2024-01-01 02:00:00.4'), (3, '2024-01-01 02:00:01.2'), (4, '2024-01-01 02:00:01.5'), (5, '2024-01-01 02:00:02.5'), (6, NULL)) v(i, t)"
    folder, db = made(events=f"SELECT i::BIGINT AS event_id, t::TIMESTAMP AS ts, 7::BIGINT AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '' AS props FROM {at}")
    assert not differs(spark, "d10_interval_self_join", folder, db)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_d19_item_sets_meet_the_classes_once(spark, made, monkeypatch):
    part = """SELECT i % 350 AS p_partkey, CASE WHEN i = 7 THEN NULL ELSE ['red bolt', 'red red', 'ring bolt', 'blue ring', 'hot', ''][i % 6 + 1] END AS p_name, ['A', 'B', 'C'][i % 3 + 1] AS p_brand,
        (i * 7 % 50)::INTEGER AS p_size FROM range(400) t(i)"""
    folder, db = made(part=part)
    seen = []
    monkeypatch.setattr(portfolio, "written", lambda df: seen.append(written(df)) or seen[-1])
    monkeypatch.setattr(scratch, "SPREAD_ROWS", 10)
    assert not differs(spark, "d19_class_coverage", folder, db)
    assert seen[0].count() < 50 and seen[0].agg({"m": "sum"}).first()[0] == 350


def test_b_landed_lines_are_packed_and_not_sorted_by_mark(spark, monkeypatch):
    folders = []
    monkeypatch.setattr(studies, "folder", lambda s: folders.append(scratch.folder(s)) or folders[-1])
    out = studies.landed(spark, str(oracle.DATA))
    names = [f.name for f in Path(folders[0].removeprefix("file://")).iterdir() if f.name.startswith("part-")]
    assert names and all(n.endswith(".gz") for n in names)
    assert out == folders[1] and not list(Path(out.removeprefix("file://")).glob("rejected=*"))


def test_m03_texts_are_read_once_a_row(spark, made):
    comment = "(VALUES ('<0.04', 'alpha = 0.05'), ('NS', 'level 5%; threshold 0.01'), ('> ,6', 'one-sided'), ('P = 2', NULL), ('=1e-3', '1-sided, significance 70%')) v(p, c)"
    a = spark.createDataFrame(duckdb.sql(f"SELECT * FROM {comment}").fetchall(), "p string, c string")
    out = results.with_judgement(text.with_p_value(a, F.col("p")), F.col("p.value"), F.col("p.op"), F.col("c"))
    assert [tuple(r) for r in out.select("p.value", "p.op", "j.met", "j.rule", "j.bar").collect()] == [(0.04, "<", True, "stated", 0.05), (0.05, ">", False, "stated", 0.01), (0.6, ">", False, "one-sided", 0.025), (None, None, None, "all agree", None), (0.001, "=", True, "one-sided", 0.025)]
    plan = plan_of(registry.QUERIES["m03_judged"](spark, str(oracle.DATA)))
    assert plan.count("regexp_extract_all(") == 1 and plan.count("regexp_extract(") == 2


def test_m11_judges_only_what_an_older_reader_read(spark, made):
    line = "SELECT (CASE WHEN i = 5 THEN NULL ELSE i % 13 END)::BIGINT AS l_orderkey, (i % 5)::INTEGER AS l_linenumber, (i % 11) / 100.0::DOUBLE AS l_discount, 0.02::DOUBLE AS l_tax FROM range(60) t(i)"
    folder, db = made(lineitem=line)
    assert not differs(spark, "m11_judged_again", folder, db)
    plan = plan_of(registry.QUERIES["m11_judged_again"](spark, folder))
    assert "Join" not in plan and plan.count("regexp_extract_all(") == 1


def test_l12_rows_of_one_file_are_dealt_out(spark, made):
    part = "SELECT i % 90 AS p_partkey, ['red bolt', 'Red Bolt', 'ring', 'blue ring', 'blue'][i % 5 + 1] AS p_name, ['A', 'B', 'C'][i % 3 + 1] AS p_brand FROM range(100) t(i)"
    folder, db = made(part=part)
    df = spark.read.parquet(f"{folder}/part.parquet")
    assert df.rdd.getNumPartitions() < scratch.spread(df, "p_partkey", 10).rdd.getNumPartitions() == 10
    assert not differs(spark, "l12_ordered_lookup", folder, db)
    cands = F.array(F.lower("p_name"))
    out = joins.ordered_lookup(df, "p_partkey", cands, df.select(F.col("p_name").alias("name"), F.col("p_brand").alias("target")))
    assert "RepartitionByExpression" in plan_of(out)
