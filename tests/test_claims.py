import random

import pytest

from paddock.operators import claims


def by_hand(scores):
    """Each table for itself, its losers one after the other."""
    out = []
    for table in {s[0] for s in scores}:
        of = {}
        for t, column, position, target, score in scores:
            if t == table:
                of.setdefault((position, column), []).append((-score, target))
        best = {c: min(options) for c, options in of.items()}
        won = {}
        for c in sorted(of):
            target = best[c][1]
            if target not in won or best[c][0] < best[won[target]][0]:
                won[target] = c
        taken = set(won)
        for c in sorted(of):
            if won[best[c][1]] == c:
                out.append((table, c[1], best[c][1], -best[c][0], "match"))
                continue
            free = [o for o in of[c] if o[1] not in taken and -o[0] > 0.4]
            if free:
                taken.add(min(free)[1])
                out.append((table, c[1], min(free)[1], -min(free)[0], "rematch"))
            else:
                out.append((table, c[1], None, 0.0, "demoted"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_claims_equal_one_after_the_other(spark, rows, seed):
    rng = random.Random(seed)
    scores = []
    for table in range(12):
        fields = [f"f{i}" for i in range(rng.randint(1, 9))]
        for position in range(rng.randint(1, 12)):
            wanted = {"f0", *rng.sample(fields, rng.randint(1, len(fields)))} if rng.random() < 0.7 else set(rng.sample(fields, 1))
            scores += [(table, f"c{position}", position, f, rng.randrange(21) / 20) for f in wanted]
    df = spark.createDataFrame(scores + [(1, None, 99, "f0", 1.0)], "upload int, col string, pos int, field string, score double")
    assert rows(claims.assign(df, "upload", "col", "pos", "field", "score")) == by_hand(scores)


def test_no_claims(spark):
    df = spark.createDataFrame([], "upload int, col string, pos int, field string, score double")
    assert claims.assign(df, "upload", "col", "pos", "field", "score").count() == 0
