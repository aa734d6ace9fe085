import random
import re

import numpy as np
import pytest

from paddock.llm import common, minmax

UPPER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(UPPER)) if w]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def by_hand(rows):
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets[r[0]] = shingles(r[1])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = sorted(sets)
    for i, a in enumerate(known):
        for b in known[:i]:
            common_ = len(sets[a] & sets[b])
            if common_ and 100 * common_ >= 75 * (len(sets[a]) + len(sets[b]) - common_):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    out = [(r[0], len(shingles(r[1])), find(r[0]), r[0] == find(r[0])) if r[0] is not None else (None, len(shingles(r[1])), None, False) for r in rows]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in minmax.near_duplicates(df).collect()), key=repr)


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else rng.choice(["new", "odd", "edit"]) + str(rng.randint(0, 99)) for w in text.split())


def test_components_equal_brute_force(documents, sentence, edges):
    rng = random.Random(11)
    rows = [(i, sentence(rng, rng.randint(20, 120)), "en", "s", 0) for i in range(40)]
    rows += [(100 + i, edited(rng, rng.choice(rows)[1], rng.choice([0.0, 0.01, 0.03, 0.06])), "en", "s", 0) for i in range(120)]
    rows += [(i + 500, rows[i][1].upper().replace(" ", "\t\n"), "en", "s", 0) for i in range(10)] + edges
    rng.shuffle(rows)
    assert result(documents(rows)) == by_hand(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_one_large_group_of_near_copies(documents, sentence, seed):
    rng = random.Random(seed)
    base = sentence(rng, 60)
    rows = [(i, edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.05, 0.08])), "en", "s", 0) for i in range(150)]
    chain = base.split()
    for i in range(150, 200):  # each a near copy of the one before only
        chain[rng.randrange(len(chain))] = f"step{i}"
        rows.append((i, " ".join(chain), "en", "s", 0))
    rng.shuffle(rows)
    assert result(documents(rows)) == by_hand(rows)


def test_the_threshold_is_exact(documents):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words[:19]), "en", "s", 0), (2, " ".join(words[:24]), "en", "s", 0), (3, " ".join(words[:25]), "en", "s", 0)]
    # 15 of 20 shingles link, 15 of 21 do not; 2 and 3 share 20 of 21
    assert result(documents(rows[:2])) == [(1, 15, 1, True), (2, 20, 1, False)]
    assert result(documents([rows[0], rows[2]])) == [(1, 15, 1, True), (3, 21, 3, True)]
    assert result(documents(rows)) == by_hand(rows)


def test_empty_table(documents):
    assert result(documents([])) == []


def test_signature_values_are_unbiased():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    other = np.concatenate((base[:300], rng.integers(0, 1 << 63, 33, dtype=np.uint64)))  # 300 of 433
    shares = []
    for k in range(40):
        a, b = minmax.min_max([common.mix(base + np.uint64(k)), common.mix(other + np.uint64(k))])
        shares.append((a == b).mean())
    assert abs(np.mean(shares) - 300 / 433) < 0.02


def test_small_sets_at_the_threshold_all_link(documents):
    """3 of 4, 6 of 8 and 9 of 12 shingles in common, where bands alone miss some."""
    rows = []
    for i in range(300):
        n = (4, 8, 12)[i % 3]
        words = [f"d{i}w{j}" for j in range(n + 4)]
        rows += [(10 * i, " ".join(words), "en", "s", 0), (10 * i + 1, " ".join(words[: n * 3 // 4 + 4]), "en", "s", 0)]
    assert result(documents(rows)) == by_hand(rows)


def test_different_texts_of_one_id_are_judged_each(spark, documents, sentence):
    rng = random.Random(21)
    a, b = sentence(rng, 40), sentence(rng, 40)
    rows = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (2, b + " more", "en", "s", 0), (1, a, "en", "s", 0), (3, a.upper(), "en", "s", 0)]
    kept = minmax.drop_near_duplicates(documents(rows))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (1, b)])
    judged = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minmax.near_duplicates(documents(rows)).collect()}
    assert judged == {(1, 36, 1, True), (2, 37, 1, False), (3, 36, 1, False)}


def test_pages_that_share_a_frame(documents, monkeypatch):
    """A third of all rows has one frame and words of its own; pairs that are compared stay few."""
    rng = random.Random(22)
    frame = [f"frame{i}" for i in range(104)]
    rows = [(i, " ".join([*frame, *(f"own{i}x{j}" for j in range(30))]), "en", "s", 0) for i in range(150)]
    rows += [(200 + i, " ".join([*frame[: rng.randint(60, 104)], f"tail{i}"]), "en", "s", 0) for i in range(30)]
    rows += [(300 + i, " ".join(f"other{i}x{j}" for j in range(50)), "en", "s", 0) for i in range(100)]
    compared = []
    links = minmax._links

    def counted(pairs, sets, percent):
        compared.append(pairs.count())
        return links(pairs, sets, percent)

    monkeypatch.setattr(minmax, "_links", counted)
    assert result(documents(rows)) == by_hand(rows)
    assert sum(compared) < 180 * 179 / 8
