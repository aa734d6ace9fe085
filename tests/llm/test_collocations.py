import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from paddock.llm import collocations

UPPER = {i: i + 32 for i in range(65, 91)}


def by_hand(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(5, len(words) - i) + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in often.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        found = []
        for p, a in often.items():
            if 100 * inside[p] < 100 * a:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


@pytest.fixture
def texts(sentence):
    rng = random.Random(8)
    fixed = [sentence(rng, n) for n in (2, 3, 4, 5, 7)]
    rows = []
    for i in range(300):
        parts = [rng.choice(fixed) if rng.random() < 0.5 else sentence(rng, rng.randint(1, 6)) for _ in range(rng.randint(1, 8))]
        rows.append((i, "".join(p.title() + rng.choice([" ", "\t ", ". ", ", ", "\n", ":"]) for p in parts), rng.choice(["en", "de", "fr", None]), "s", 0))
    return rows + [(500 + i, "hot pair " * 400, "en", "s", 0) for i in range(3)] + [(600, "é漢字 🙂, é漢字 🙂; " * 30, "fr", "s", 0)]


@pytest.mark.parametrize("least,top", [(5, 2000), (20, 7)])
def test_phrases_equal_brute_force(documents, rows, texts, edges, least, top):
    given = texts + edges
    assert rows(collocations.collocations(documents(given), least, top)) == by_hand(given, least, top)


def test_many_small_tries(documents, rows, texts, monkeypatch):
    monkeypatch.setattr(collocations, "TRIE_PHRASES", 40)
    assert rows(collocations.collocations(documents(texts), 10)) == by_hand(texts, 10, 2000)


def test_a_full_bitmap_loses_nothing(documents, rows, texts, monkeypatch):
    monkeypatch.setattr(collocations, "_bitmap", lambda phrases: np.full(1 << (collocations.FILTER_BITS - 3), 255, dtype=np.uint8))
    assert rows(collocations.collocations(documents(texts[:100]), 10)) == by_hand(texts[:100], 10, 2000)


def test_production_count(documents, rows, texts):
    assert rows(collocations.collocations(documents(texts))) == by_hand(texts, 100, 2000)


def test_nothing_frequent(documents, rows):
    assert rows(collocations.collocations(documents([]))) == rows(collocations.collocations(documents([(1, "a b c", "en", "s", 0)]))) == []


@pytest.mark.parametrize("seed", range(4))
def test_trie_holds_every_phrase_in_its_slot(seed):
    rng = random.Random(seed)
    phrases = sorted({tuple(rng.randrange(1, 200) ** 2 for _ in range(rng.randint(1, 5))) for _ in range(600)})
    trie = collocations.DoubleArrayTrie(np.array([s for p in phrases for s in p], dtype=np.uint64), np.array([len(p) for p in phrases]))
    slots = {}
    for p, end in zip(phrases, trie.slot.tolist()):
        slot = 0
        for symbol in p:
            child = int(trie.base[slot]) + int(trie.code[np.searchsorted(trie.alphabet, symbol)])
            assert trie.check[child] == slot
            slot = child
        assert slot == end and slots.setdefault(slot, p) == p
