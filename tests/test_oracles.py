"""Registered queries beside their statements: a few of each family, or all with TALLYFORGE_ALL=1."""

import os

import pytest
from compare import compare, duck

from tallyforge.catalogue import ORACLES, QUERIES

SF_DIR = os.environ.get("TALLYFORGE_SF_DIR", "/root/testdata/sf0.01")
SOME = """tpcds_001 tpcds_002 tpcds_005 tpcds_010 tpcds_014 tpcds_016 tpcds_021 tpcds_030 tpcds_038 tpcds_045 tpcds_047 tpcds_050 tpcds_052
tpcds_054 tpcds_064 tpcds_067 tpcds_070 tpcds_075 tpcds_078 tpcds_080 tpcds_087 tpcds_096 cat_01 cat_02 cat_06_sales src_07 src_10 src_17
snk_02 snk_04 snk_16 prj_08 flt_03 joi_05 joi_08 joi_20 agg_08 agg_16 win_01 win_07 win_08 srt_04 set_04 sub_03 str_10 str_12 dat_07 mth_06
arr_02 jsn_05 jsn_06 xml_01 stm_04 stm_12 snk_14 ver_03 ver_08 ver_12 ml_02 ml_07 ml_11 evt_01 evt_02 evt_08 evt_24 evt_25 evt_31 job_04
job_06 job_14""".split()
NAMES = [n for n in QUERIES if os.environ.get("TALLYFORGE_ALL") or n.startswith(tuple(SOME))]


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_statement(spark, con, name):
    verdict, rows, _ = compare(spark, SF_DIR, QUERIES[name], ORACLES.get(name), con)
    assert verdict.startswith("ok"), verdict
    assert rows > 0


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)


def test_every_numbered_report_is_there():
    numbers = {int(n.split("_")[1][:3]) for n in QUERIES if n.startswith("tpcds_")}
    assert numbers == set(range(1, 103))
    assert "tpcds_014b_cross_items_this_year_last_year" in QUERIES
