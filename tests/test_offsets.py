from formweave.operators import matching
from pyspark.sql import functions as F


def test_tokens_meet_parts_by_stretches_of_their_form(spark):
    rows = [(f, p, (7 * p + f) % 150 if p % 4 else 0) for f in (1, 2) for p in range(40)] + [(3, 0, None), (3, 1, 2)]
    parts = spark.createDataFrame(rows, "form long, part long, words long")
    tokens = parts.select("form").distinct().select("form", F.explode(F.sequence(F.lit(0), F.lit(4000))).alias("token"))
    out = matching.owner_of_tokens(tokens, parts)
    want = {}
    for form in (1, 2, 3):
        owners = [p for f, p, n in rows if f == form for _ in range(n or 0)]
        want |= {(form, t): owners[t] if t < len(owners) else None for t in range(4001)}
    got = [((r.form, r.token), r.part) for r in out.collect()]
    assert len(got) == len(want) and dict(got) == want
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "Join LeftOuter" in plan and any("Join LeftOuter" in x and x.count("at#") >= 2 for x in plan.split("\n"))
