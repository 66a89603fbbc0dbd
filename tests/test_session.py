import os

import pytest

from larkspur import session as S


def test_kept_tables_are_cleared(spark):
    df = S.keep(spark.range(3).toDF("x"), "t")
    assert df.count() == 3 and os.listdir(S.shared_folder(spark))
    assert S.clear_kept(spark) >= 1
    with pytest.raises(Exception):
        df.count()
