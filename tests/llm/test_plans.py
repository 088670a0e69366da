import re

import pytest

from quillstone.llm.queries import QUERIES
from tests.test_plans import SF, plan


@pytest.mark.parametrize("name", ["op4_url_filter", "op8_minhash"])
def test_native_queries_run_no_python(spark, name):
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan(QUERIES[name](spark, SF)))


def test_url_filter_reads_no_page_text(spark):
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan(QUERIES["op4_url_filter"](spark, SF))


def test_blocks_come_back_without_a_shuffle(spark):
    text = plan(QUERIES["op9_byte_bpe"](spark, SF))
    assert "Bucketed: true" in text
