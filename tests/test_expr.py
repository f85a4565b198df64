import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointerloom.functions.expr import (
    angle_bin,
    clip01,
    exceeds,
    fold_angle,
    normalised_entropy,
    python_float,
)
from pointerloom.operators import skew

TEXTS = [
    "1", "-2.5", "+3", ".5", "5.", "1e3", "1E-2", " 7 ", "\t8\n", "1_000", "1__0", "_1", "1_", "1366d", "2f", "0x10",
    "nan", "-NaN", "inf", "-Infinity", "+inf", "infinite", "", " ", ".", "e5", "1e", "1.2.3", "1 2", "--1", "1e400",
    "1_0.0_1e1_0", "٣", "true", "1,5", "-", "+-1", "1e+5", "1-2",
]


def test_texts_as_python_reads_them(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = dict(df.select("t", python_float(F.col("t"))).collect())
    for text in TEXTS:
        try:
            want = float(text) if text.isascii() else None
        except ValueError:
            want = None
        same = got[text] is want or got[text] == want or (want and math.isnan(want) and math.isnan(got[text]))
        assert same, (text, got[text], want)


def test_clip(spark):
    df = spark.createDataFrame([(-1.0,), (0.25,), (7.0,), (math.nan,)], "v double")
    got = [r[0] for r in df.selectExpr(clip01("v")).collect()]
    assert got[:3] == [0.0, 0.25, 1.0] and math.isnan(got[3])


def test_angles(spark):
    rng = np.random.default_rng(1)
    angles = [*map(float, rng.uniform(-math.pi, math.pi, 300)), *map(float, np.linspace(-np.pi, np.pi, 9)), math.nan, None]
    df = spark.createDataFrame([(a,) for a in angles], "a double")
    for a, got in df.selectExpr("a", angle_bin("a")).collect():
        if a is None or math.isnan(a):
            assert got is None
        else:
            assert got == int(np.histogram([a], bins=8, range=(-np.pi, np.pi))[0].argmax())
    turns = spark.createDataFrame([(0.0,), (-3.0,), (6.0,), (math.pi,), (math.nan,)], "d double")
    folded = [r[0] for r in turns.selectExpr(fold_angle("d")).collect()]
    assert folded[:4] == pytest.approx([0, 3, 2 * math.pi - 6, math.pi]) and math.isnan(folded[4])
    assert [r[0] for r in turns.selectExpr(exceeds("d", 2.0)).collect()] == [False, False, True, True, False]


@pytest.mark.parametrize("counts,want", [
    ([0] * 8, 0.0), ([5] + [0] * 7, 0.0), ([1] * 8, 1.0), ([2, 2] + [0] * 6, 1 / 3),
])
def test_entropy(spark, counts, want):
    names = [f"c{i}" for i in range(8)]
    df = spark.createDataFrame([(*counts, sum(counts))], ", ".join(f"{n} long" for n in (*names, "n")))
    got = df.selectExpr(normalised_entropy(names, "n")).first()[0]
    assert got == pytest.approx(want) and math.copysign(1, got) == 1


class Session:
    """Just what the choice of the shared folder asks for."""

    def __init__(self, setting=None, folder=None, master="local[2]"):
        self.conf = self
        self.sparkContext = self
        self.setting, self.folder, self.master = setting, folder, master

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.setting or default

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


def test_shared_folder():
    assert skew.shared_folder(Session("s3a://bucket/x/", master="yarn")) == "s3a://bucket/x"
    assert skew.shared_folder(Session(folder="hdfs:/y", master="yarn")) == "hdfs:/y"
    local = Session()
    assert skew.shared_folder(local) == skew.shared_folder(local) != ""
    with pytest.raises(RuntimeError):
        skew.shared_folder(Session(master="yarn"))


def test_number_parsing_stays_short():
    """Each use of a text is written out in the generated code, and a long method is never compiled."""
    assert str(python_float(F.col("the_text"))).count("the_text") <= 4
