"""Inner tables go with their scratch, kept ones with the one around it."""

import os

from fairlend.llm.tables import scratch, stored


def place(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_scratch_removes_what_is_not_kept(spark):
    df = spark.range(5)
    free = place(stored(df, "free"))
    with scratch(spark):
        inner = stored(df, "inner")
        with scratch(spark):
            deep, kept = place(stored(inner, "deep")), stored(inner, "kept", keep=True)
        assert not os.path.exists(deep) and kept.count() == 5
        out = stored(kept, "out", keep=True)
        paths = [place(inner), place(kept)]
    assert os.path.exists(free) and out.count() == 5 and not any(map(os.path.exists, paths))


def test_scratch_removes_after_a_failure(spark):
    path = None
    try:
        with scratch(spark):
            path = place(stored(spark.range(3), "lost"))
            raise KeyError
    except KeyError:
        pass
    assert path and not os.path.exists(path)
