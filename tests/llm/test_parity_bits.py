"""Sets differ in no fewer hashes than parity bits; tables that nothing reads any more go."""

import glob

import numpy as np
import pytest

from daytrail.llm.textscan import mixed, parity_bits
from daytrail.session import checkpoint_dir, cut_lineage, discard


@pytest.mark.parametrize("many", [64, 256, 512])
def test_bits_differ_in_no_more_than_the_sets(many):
    rng = np.random.default_rng(3)
    base = mixed(np.arange(1, 400, dtype=np.uint64))
    sets = [rng.choice(base, k, replace=False) for k in (1, 2, 50, 60, 200, 399)]
    words = parity_bits(np.concatenate(sets), np.append(0, np.cumsum([len(s) for s in sets])), many)
    assert words.shape == (len(sets), many // 64)
    for x, a in zip(sets, words, strict=True):
        for y, b in zip(sets, words, strict=True):
            assert sum(int(w).bit_count() for w in a ^ b) <= len(np.setxor1d(x, y))
    assert parity_bits(np.zeros(0, np.uint64), np.zeros(1, np.int64), many).shape == (0, many // 64)


def test_a_discarded_table_is_gone(spark):
    before = set(glob.glob(f"{checkpoint_dir(spark)}/daytrail-*"))
    table = cut_lineage(spark.range(10).repartition(3))
    assert set(glob.glob(f"{checkpoint_dir(spark)}/daytrail-*")) - before
    discard(table)
    assert set(glob.glob(f"{checkpoint_dir(spark)}/daytrail-*")) == before


def test_only_own_tables_are_discarded(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/given")
    with pytest.raises(ValueError):
        discard(spark.read.parquet(f"{tmp_path}/given"))
    assert spark.read.parquet(f"{tmp_path}/given").count() == 3
