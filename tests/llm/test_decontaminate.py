import random
import re
from collections import Counter

from pyspark.sql import functions as F

from paddock.llm import decontaminate

UPPER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(UPPER)) if w]


def grams(tokens, size):
    return Counter(tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1))


def by_hand(rows, items):
    """All windows of all documents against all items."""
    out = {}
    for doc_id, text in rows:
        w = words(text)
        for item_id, item in items:
            t = words(item)
            size = min(5, len(t))
            if not t or len(w) < size:
                continue
            theirs = grams(t, size)
            for start in range(max(1, len(w) - len(t) + 1)):
                ours = grams(w[start : start + len(t)], size)
                lesser, greater = sum((ours & theirs).values()), sum((ours | theirs).values())
                if 100 * lesser >= 75 * greater:
                    key = (doc_id, item_id)
                    out[key] = max(out.get(key, 0), lesser / greater)
    return out


def benchmark(spark, items):
    return spark.createDataFrame([(*i, "x", 3) for i in items], "item_id bigint, text string, key string, size int")


def result(spark, docs, items):
    got = decontaminate.find_items(docs, benchmark(spark, items)).collect()
    return {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got}


def test_found_items_equal_brute_force(spark, documents, sentence, edges):
    rng = random.Random(6)
    items = [(i, sentence(rng, rng.randint(12, 60))) for i in range(15)] + [(50, "Short item"), (51, "four words are here"), (52, None), (53, ""), (None, "an item without an id has words as well")]
    rows = [(i, sentence(rng, rng.randint(1, 150))) for i in range(40)]
    for i in range(40, 110):
        item = rng.choice(items)[1] or ""
        w = item.split()
        for _ in range(rng.randint(0, 3)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(["changed", "words", ""])
        rows.append((i, sentence(rng, rng.randint(0, 40)) + "\n" + " ".join(w).upper() + " " + sentence(rng, rng.randint(0, 40))))
    rows += [(200, items[0][1]), (201, " ".join(items[1][1].split()[:-2])), (202, (items[2][1] + " ") * 3), (203, "a short  ITEM here"), (204, "short item")]
    table = documents([(*r, "en", "s", 0) for r in rows] + edges)
    want = {k: round(v, 9) for k, v in by_hand(rows + [(e[0], e[1]) for e in edges], items).items()}
    assert result(spark, table, items) == want and len(want) > 25


def test_moved_inserted_and_repeated_words(spark, documents, sentence):
    """Swapped parts, inserted words, and differences that are one repeated word, down to a similarity of exactly 0.75."""
    rng = random.Random(16)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(rng.choice([40, 50, 74])))) for i in range(40)]
    rows = []
    for i, item in items:
        w = item.split()
        turn = rng.choice([2, 3])
        rows.append((i, " ".join([sentence(rng, 40), *w[len(w) // turn :], *w[: len(w) // turn], sentence(rng, 40)])))
        at = rng.randrange(10, len(w))
        rows.append((100 + i, " ".join([sentence(rng, 9), *w[:at], *["put", "in"] * rng.randint(1, 3), *w[at:], sentence(rng, 9)])))
        same = -(-6 * (len(w) - 4) // 7) + 4  # the fewest words in common that reach 0.75
        rows.append((200 + i, " ".join([sentence(rng, 9), *w[:same], *["again"] * (len(w) - same), sentence(rng, 9)])))
        rows.append((300 + i, " ".join([*w[: same - 1], *["again"] * (len(w) - same + 1)])))
    want = {k: round(v, 9) for k, v in by_hand(rows, items).items()}
    assert result(spark, documents([(*r, "en", "s", 0) for r in rows]), items) == want
    assert sum(k[0] >= 200 and v < 0.77 for k, v in want.items()) >= 30


def test_repeated_words_count_as_often_as_they_occur(spark, documents):
    items = [(1, "a a a a a a a a a a"), (2, "x y x y x y x y x y x y")]
    rows = [(1, "a a a a a a a a a"), (2, "a a a a a a a"), (3, "x y x y x y x y x y"), (4, "y x y x y x y x y x y x")]
    want = {k: round(v, 9) for k, v in by_hand(rows, items).items()}
    assert result(spark, documents([(*r, "en", "s", 0) for r in rows]), items) == want


def test_empty_tables(spark, documents):
    some = [(1, "one two three four five six seven", "en", "s", 0)]
    assert result(spark, documents([]), [(1, some[0][1])]) == {}
    assert result(spark, documents(some), []) == {}
    assert decontaminate.drop_contaminated(documents(some), benchmark(spark, [])).count() == 1


def test_clean_documents_stay_whole(spark, documents, sentence, edges):
    rng = random.Random(9)
    item = sentence(rng, 30)
    rows = edges + [(1, "before " + item + " after", "en", "s", 0), (2, sentence(rng, 80), "en", "s", 0), (1, "before " + item + " after", "en", "s", 0), (3, None, "en", "s", 0)]
    kept = decontaminate.drop_contaminated(documents(rows), benchmark(spark, [(1, item)]))
    assert kept.schema == documents(rows).schema
    assert sorted((tuple(r[:5]) for r in kept.collect()), key=repr) == sorted([r for r in rows if r[0] != 1], key=repr)


def test_fingerprints_of_like_sets_lie_within_the_radius(spark):
    """A quarter of the shingles differs; random sets lie far apart."""
    base = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.xxhash64(i, "id"))
    other = F.transform(F.sequence(F.lit(5), F.lit(44)), lambda i: F.xxhash64(i, "id"))
    far = F.transform(F.sequence(F.lit(100), F.lit(139)), lambda i: F.xxhash64(i, "id"))
    rows = spark.range(300).select(base.alias("base"), other.alias("other"), far.alias("far"))
    marks = rows.select(*[decontaminate.fingerprint(c).alias(c) for c in ("base", "other", "far")])
    near, apart = marks.select(F.max(F.expr("bit_count(base ^ other)")), F.avg(F.expr("bit_count(base ^ far)"))).first()
    assert near <= decontaminate.RADIUS and 29 < apart < 35
