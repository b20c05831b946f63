"""Spans against gold spans: the greedy match by brute force, without a Python call for each document."""

import random

from siftwork.operators import metrics


def test_matched_equals_the_greedy_match(spark):
    r = random.Random(4)
    row = lambda n: (r.choice([None, *range(12)]), n, a := r.randint(0, 40), a + r.randint(1, 12), r.choice(["A", "B"]))
    predicted, gold = [row(n) for n in range(150)], [row(n) for n in range(150)]
    want = {}
    for key in {(x[0], x[4]) for x in predicted + gold}:
        mine, left, tp = [x for x in predicted if (x[0], x[4]) == key], [x for x in gold if (x[0], x[4]) == key], 0
        for p in mine:
            hit = next((g for g in left if min(p[3], g[3]) > max(p[2], g[2]) and (min(p[3], g[3]) - max(p[2], g[2])) / (max(p[3], g[3]) - min(p[2], g[2])) >= 0.5), None)
            if hit:
                left.remove(hit)
                tp += 1
        want[key] = (tp, len(mine) - tp, len(left))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, ord int, start int, end int, type string")
    out = metrics.matched(frame(predicted), frame(gold))
    assert {(x.doc_id, x.type): (x.tp, x.fp, x.fn) for x in out.collect()} == want and any(v[0] for v in want.values())
    assert "CoGroup" not in out._jdf.queryExecution().executedPlan().toString()
