"""Scratch tables go with the block that made them."""

import os

import pytest

from memlattice.llm.common import Scratch, temporary


def test_a_failing_block_leaves_no_tables(spark):
    before = Scratch(spark, "before")
    kept = before.save(spark.range(3))
    with pytest.raises(ValueError, match="stage"), temporary():
        inside = Scratch(spark, "inside")
        inside.save(spark.range(5))
        folder = inside.base.removeprefix("file:").replace("//", "", 1)
        assert os.path.isdir(folder)
        raise ValueError("stage")
    assert not os.path.exists(folder) and kept.count() == 3
    before.remove()
