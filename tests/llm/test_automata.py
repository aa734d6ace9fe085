import random
import re

import pytest

from paddock.llm import automata


def by_hand(rows, window=13):
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w] for _, text, *_ in rows]
    least = {}
    for (doc, *_), tokens in zip(rows, split):
        if doc is not None:
            for i in range(len(tokens) - window + 1):
                w = tuple(tokens[i : i + window])
                least[w] = min(doc, least.get(w, doc))
    out = []
    for (doc, *_), tokens in zip(rows, split):
        gone = set()
        if doc is not None:
            for i in range(len(tokens) - window + 1):
                if least[tuple(tokens[i : i + window])] < doc:
                    gone.update(range(i, i + window))
        out.append((doc, len(tokens), len(gone), " ".join(t for i, t in enumerate(tokens) if i not in gone)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in automata.remove_passages(df).collect()), key=repr)


@pytest.fixture
def mixed(sentence):
    def make(seed):
        rng = random.Random(seed)
        passages = [sentence(rng, n) for n in (12, 13, 14, 40, 90)]
        rows = []
        for i in range(90):
            parts = [sentence(rng, rng.randint(0, 25)) for _ in range(3)]
            parts.insert(rng.randint(0, 3), rng.choice(passages))
            if rng.random() < 0.4:  # a part of a passage
                words = rng.choice(passages[3:]).split()
                a = rng.randrange(len(words) - 20)
                parts.insert(rng.randint(0, 3), "\t\n".join(words[a : a + rng.randint(11, 20)]))
            rows.append((i, " ".join(parts), "en", "s", 0))
        rows += [(200 + i, rng.choice(rows)[1], "en", "s", 0) for i in range(10)]
        rows += [(300 + i, "again " * rng.randint(10, 60), "en", "s", 0) for i in range(4)]
        rows += [(400, rows[0][1], "en", "s", 0), (400, rows[1][1] + " more words", "en", "s", 0)] * 2
        rng.shuffle(rows)
        return rows

    return make


@pytest.mark.parametrize("seed", [1, 2])
def test_words_equal_brute_force(documents, mixed, edges, seed, monkeypatch):
    monkeypatch.setattr(automata, "SHARD_WORDS", 300)
    monkeypatch.setattr(automata, "STREAM_WORDS", 500)
    rows = mixed(seed) + edges
    assert result(documents(rows)) == by_hand(rows)


def test_windows_that_the_owner_of_a_gram_lacks(documents):
    rng = random.Random(5)
    gram = " ".join(f"g{i}" for i in range(6))
    around = [(" ".join(f"l{k}x{i}" for i in range(9)), " ".join(f"r{k}x{i}" for i in range(9))) for k in range(6)]
    rows = [(i, " ".join((around[rng.randrange(6)][0], gram, around[rng.randrange(6)][1])), "en", "s", 0) for i in range(60)]
    assert result(documents(rows)) == by_hand(rows)


def test_a_passage_in_a_third_of_all_documents(documents, sentence, monkeypatch):
    monkeypatch.setattr(automata, "STREAM_WORDS", 200)
    rng = random.Random(6)
    passage = sentence(rng, 60)
    rows = [(i, f"{sentence(rng, 30)} {passage if i % 3 == 0 else ''} {sentence(rng, 30)}", "en", "s", 0) for i in range(150)]
    assert result(documents(rows)) == by_hand(rows)


def test_empty_table(documents):
    assert result(documents([])) == []


@pytest.mark.parametrize("seed", range(3))
def test_automaton_finds_all_windows(seed):
    rng = random.Random(seed)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))] for _ in range(8)]
    automaton = automata.SuffixAutomaton(4)
    for doc, text in enumerate(texts):
        automaton.add(text, doc)
    automaton.seal()
    for doc in range(9):
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(60)]
        windows = [text[i : i + 4] for i in range(57)]
        want = [any(t[j : j + 4] == w for t in texts[:doc] for j in range(len(t) - 3)) for w in windows]
        assert automaton.found(text, doc).tolist() == want
