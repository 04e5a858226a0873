"""What queries read and deal out, by their plans: costs that grow with the tables."""

import re

import pytest
from itemforge.plans.queries import QUERIES


def plan_of(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def scans(plan, table):
    return len(re.findall(rf"FileScan parquet .*/{table}\.parquet", plan))


def test_segments_of_a_layout_take_one_pass(spark, sf_dir):
    assert scans(plan_of(spark, sf_dir, "layout_segments"), "lineitem") == 1


def test_layouts_deal_line_items_out_once(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "page_layouts")
    assert scans(plan, "lineitem") == 1 and len(re.findall(r"\bExchange ", plan)) <= 3  # line items, orders, pages of a document


@pytest.mark.parametrize("name", ["segment_extents", "question_texts"])
def test_whole_segments_take_one_pass(spark, sf_dir, name):
    plan = plan_of(spark, sf_dir, name)
    assert scans(plan, "lineitem") == 1 and len(re.findall(r"FileScan|\bExchange ", plan)) == 2


def test_answer_keys_are_dealt_out_by_document(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "answer_keys")
    dealt = re.findall(r"Exchange (\w+\([^)]*\))", plan)
    assert len(dealt) <= 6 and not any("page" in d or "number" in d for d in dealt), dealt
