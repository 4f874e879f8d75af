"""The registered queries against their SQL, and the entry without the optional subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from needlework import catalogue

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(pdf):
    return sorted(map(tuple, pdf[sorted(pdf.columns)].astype(object).where(pdf[sorted(pdf.columns)].notna(), None).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    own, other = __spark_entry__.queries()[name](spark, sf).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    assert rows(own) == rows(other)


def test_every_query_has_its_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "doc_length", "tf"]


def test_plans(spark, sf):
    plan = lambda name: __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().toString()
    one = plan("topk_documents")
    assert "TakeOrderedAndProject" in one and "StringContains(text,ata)" in one and "ReadSchema: struct<doc_id:bigint,text:string>" in one
    batch = plan("topk_batch")
    assert "WindowGroupLimit" in batch and "BroadcastNestedLoopJoin" in batch and "CartesianProduct" not in batch
    assert "ReadSchema: struct<text:string>" in plan("document_frequency")


def test_entry_without_the_optional_part(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in (".git", "needlework", "corpus_pipeline.py", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "needlework").mkdir()
    for p in (ROOT / "needlework").iterdir():
        if p.name != "llm":
            (tmp_path / "needlework" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'topk_documents' in q and not any(x.startswith('op') and x[2].isdigit() for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}, check=True)


def test_folders_need_a_local_master_or_a_setting(spark, monkeypatch):
    from needlework.sources import shared

    class Elsewhere:
        sparkContext = type("Context", (), {"master": "spark://host:7077"})
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError):
        shared.shared_folder(Elsewhere, "x")
    Elsewhere.conf = type("Conf", (), {"get": staticmethod(lambda key, default: "hdfs://a/b/")})
    assert shared.shared_folder(Elsewhere, "x").startswith("hdfs://a/b/needlework/")
