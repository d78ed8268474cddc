"""Registered queries next to the SQL that states their results."""

import os
import subprocess
import sys

import compare
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ("agg1_contact_merge", "win2_email_cap", "agg2_lead_documents", "agg3_lead_score", "fil3_search", "lim2_display",
         "snk1_flat_rows", "jn10_robots_gate", "jn10_robots_groups", "src16_robots_rules", "htm15_cookies",
         "htm15_two_cookies", "htm11_markdown_stated", "htm11_headings", "htm12_text_stated", "url3_normalise",
         "url5_scrapeable", "url7_block_reason", "ups3_interval_parse", "con8_valid_email", "win6_burned")


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(session, duck, name):
    assert compare.compare(session, duck, SF, name, entry.queries()[name], entry.oracle_sql()[name]) is None


TITLES = ("A", "B", "What is new", "Best &amp; all", "token = &quot;77", "and&amp;&amp", "x &lt;y&gt; &eacute; &#65;", "C", "D", "E", "Ratings", "topé x",
          "a&nbsp;b", "&amp;amp; c")


@pytest.mark.parametrize("name", ["htm3_title", "htm10_directory_pages", "htm11_headings"])
def test_titles_are_read_as_the_sql_reads_them(session, tmp_path, name):
    rows = [(i, f"https://h{i}.net/p", f"<html><head><title>{t}</title></head><body><h1>{t}</h1><p>x</p></body></html>") for i, t in enumerate(TITLES)]
    session.createDataFrame(rows, "page_id bigint, url string, html string").toPandas().to_parquet(str(tmp_path / "pages.parquet"))
    assert compare.compare(session, compare.duck(str(tmp_path)), str(tmp_path), name, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registries_are_read_without_a_session():
    """Names and SQL are listed before any session exists, in a fresh interpreter."""
    code = ("import __spark_entry__ as e; from pyspark.sql import SparkSession; "
            "assert SparkSession.getActiveSession() is None; "
            "q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q); "
            "import bench; assert SparkSession.getActiveSession() is None")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
