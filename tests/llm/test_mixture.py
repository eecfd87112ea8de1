import random

from textloom.llm.mixture import cube_sample, flight, landing, mix


def test_flight_keeps_both_sums():
    rng = random.Random(5)
    for n in (1, 2, 3, 50, 400):
        sizes = [float(rng.randrange(1, 100)) for _ in range(n)]
        chances = [0.37] * n
        out = flight(sizes, chances, n)
        assert sum(0 < p < 1 for p in out) <= 2
        assert abs(sum(out) - sum(chances)) < 1e-6 and abs(sum(a * b for a, b in zip(sizes, out)) - sum(a * b for a, b in zip(sizes, chances))) < 1e-4
        assert all(p in (0.0, 1.0) for p in landing(sizes, out))


def test_inclusion_is_unbiased():
    hits = [0.0] * 12
    for seed in range(600):
        for i, p in enumerate(landing(list(map(float, range(1, 13))), flight(list(map(float, range(1, 13))), [0.5] * 12, seed))):
            hits[i] += p / 600
    assert all(0.35 < h < 0.65 for h in hits)


def test_blocks(spark):
    rows = spark.range(3000).selectExpr("id", "'s' AS source", "id % 97 + 1 AS tokens", "0.4D AS chance")
    out = cube_sample(rows, {"s": 3000}, block_rows=200).toPandas()
    assert len(out) == 3000 and set(out["chance"]) <= {0.0, 1.0}
    assert abs(out["chance"].sum() - 1200) <= 2 and abs((out["chance"] * out["tokens"]).sum() - 0.4 * out["tokens"].sum()) <= 200


def test_mix(spark):
    docs = [(i, "big", "x" * (20 + i % 9), "c") for i in range(200)] + [(1000 + i, "small", "y" * 30, "c") for i in range(20)] + [(5000, None, "z", "c"), (5001, "big", None, "c"), (None, "big", "z", "c"), (5002, "other", "z", "c"), (0, "big", "x" * 20, "c")]
    plan = [("big", 0.7, 2), ("small", 0.2, 3), ("none", 0.1, 2)]
    d = spark.createDataFrame(docs, "id long, source string, text string, tokens string")
    p = spark.createDataFrame(plan, "source string, target_share double, max_repeat int")
    selection, report = mix(d, "id", "source", "text", p, vocabulary="bytes")
    r = {x["source"]: x for x in report.collect()}
    total = sum(len(t) for _, s, t, _ in docs[:220]) + 20
    assert r["none"]["falls_short"] and not r["big"]["falls_short"] and not r["small"]["falls_short"]
    assert abs(r["big"]["mixed_tokens"] - 0.7 * total) <= 40 and abs(r["small"]["mixed_tokens"] - 0.2 * total) <= 60
    have = {"big": sum(len(t) for _, s, t, _ in docs[:200]) + 20, "small": 600, "none": 0}
    assert {s for s, x in r.items() if x["falls_short"]} == {s for s, share, cap in plan if cap * have[s] < share * total}
    capped = spark.createDataFrame([("big", 0.2, 2), ("small", 0.8, 3)], "source string, target_share double, max_repeat int")
    c = {x["source"]: x for x in mix(d, "id", "source", "text", capped, vocabulary="bytes")[1].collect()}
    assert c["small"]["falls_short"] and c["small"]["copies"] == 60 and c["small"]["mixed_tokens"] == 1800 and not c["big"]["falls_short"]
    assert selection.where("copies > 3").count() == 0 and selection.where("source = 'other'").count() == 0
    assert mix(d.where("false"), "id", "source", "text", p, vocabulary="bytes")[0].count() == 0
    assert mix(d, "id", "source", "text", p.where("false"), vocabulary="bytes")[1].count() == 0
