import re

from grainwise.operators import composite as ci
from grainwise.plans.q_profile import rounded

#: Bytecode of a method beyond which the JVM doesn't compile it.
JIT_LIMIT = 8000


def test_no_generated_method_of_the_rounded_curves_is_too_large_to_compile(spark, capsys):
    rows = [(None,) * len(ci.CURVES), *[(float(k),) * len(ci.CURVES) for k in range(5)]]
    df = spark.createDataFrame(rows, ", ".join(f"{p} double" for p in ci.CURVES))
    q = [f"q_{p}" for p in ci.CURVES]
    out = rounded(ci.subindex_all(df), 9, *q).select(*q)
    out.explain("codegen")
    assert all(int(n) < JIT_LIMIT for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))
    got = sorted(out.collect(), key=lambda r: (r.q_ph is not None, r.q_nitrite or 0))
    assert list(got[0]) == [None] * len(q)
    assert [r.q_nitrite for r in got[1:]] == [0.0, 50.0, 75.0, 100.0, 100.0]
