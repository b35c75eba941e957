import random

import numpy as np
import pytest

from tidewell.llm.fmindex import FMIndex
from tidewell.llm.leakage import Phrases, Shard, held_share, leaked_items, phrase_matches, removal_spans
from tidewell.llm.words import words

LEXICON = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "tru", "sel") for b in ("n", "rt", "l") for c in ("a", "o", "ex", "um", "ing", "ed", "ar")]


def passage(rng, n):
    return " ".join(rng.choice(LEXICON) for _ in range(n))


@pytest.mark.parametrize("size,top", [(1, 1), (60, 2), (900, 4), (20_000, 30)])
def test_index_equals_a_plain_search(size, top):
    rng = np.random.default_rng(size)
    text = rng.integers(0, top + 1, size)
    text[size // 2:size // 2 + size // 4] = text[:size // 4]
    keep = np.ones(size, bool)
    keep[1:] = (text[1:] != 0) | (text[:-1] != 0)
    text = text[keep]
    index = FMIndex(text, top)
    phrases = rng.integers(1, top + 1, (200, 4))
    low, high = index.search(phrases)
    for phrase, a, b in zip(phrases, low, high):
        want = [i for i in range(len(text) - 3) if (text[i:i + 4] == phrase).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, held int")
    i = spark.createDataFrame(items, "item_id string, text string, doc_id long")
    return {(r["doc_id"], r["item_id"]) for r in leaked_items(d, i, **options).collect()}


def test_altered_partial_and_copied_passages(spark):
    rng = random.Random(3)
    items = [(f"i{k}", passage(rng, 120), 1) for k in range(12)] + [("copy of i0", None, 1), ("short", "Sesame street", 1), ("none", "...", 1)]
    items[12] = ("copy of i0", items[0][1].upper(), 1)
    docs, want = [], set()

    def add(text, *names):
        docs.append((len(docs), text, "clash", 0))
        want.update((len(docs) - 1, n) for n in names)

    both = ("i0", "copy of i0")
    add(passage(rng, 200) + " " + items[0][1] + " " + passage(rng, 50), *both)
    add(items[0][1].upper().replace(" ", "\n\n"), *both)
    w = items[1][1].split()
    add(" ".join(x if i % 9 else "zzz" for i, x in enumerate(w)), "i1")
    add(" ".join(w[40:100]), "i1")
    add(" ".join(w[:30]))  # a quarter is a quotation, no leak
    add("-\n".join((items[2][1][:300], items[2][1][300:])).replace("o", "ó"), "i2")
    add(items[3][1].replace("ar", "a​r"), "i3")
    add(" ".join(reversed(items[4][1].split())))
    add(passage(rng, 6000))
    add("we saw sesame street twice", "short")
    add(None), add(""), add("   "), add("日本語" * 500)
    add(items[5][1] + " " + passage(rng, 900) + " " + items[6][1], "i5", "i6")
    for options in ({}, {"shard_words": 500}, {"block_items": 4}, {"block_items": 1, "shard_words": 3000}):
        assert found(spark, docs, items, **options) == want, options


def test_empty_tables_and_spans(spark):
    assert found(spark, [], [("i", "some words stand here for a test", 1)]) == set()
    assert found(spark, [(1, "some words", "x", 0)], []) == set()
    spans = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 8, 20), (1, "c", 30, 40), (2, "a", 1, 2)], "doc_id long, item_id string, span_start int, span_end int")
    assert sorted(tuple(r) for r in removal_spans(spans).collect()) == [(1, 0, 20, 2), (1, 30, 40, 1), (2, 1, 2, 1)]


def test_words_fold_layout():
    assert words("The Café-\nteria ﬁxed 45% of​ it") == [b"the", b"cafeteria", b"fixed", b"45", b"percent", b"of", b"it"]
    assert words(None) == [] == words("")


def brute_share(doc, item, width=4):
    """Longest common sequence over the word pairs that equal phrases and their bridges cover, cell by cell."""
    pairs = {(p, j) for p in range(len(doc) - width + 1) for j in range(len(item) - width + 1) if item[j] > 0 and (doc[p:p + width] == item[j:j + width]).all()}
    cells = {(p + t, j + t) for p, j in pairs for t in range(width)}
    ends = {(p + width, j + width) for p, j in pairs if (p + 1, j + 1) not in pairs}
    starts = {(p, j) for p, j in pairs if (p - 1, j - 1) not in pairs}
    for p, j in ends:
        for over in (1, 2, 3):
            for under in (1, 2):
                if (p + over, j + under) in starts:
                    cells |= {(p + t, j + t) for t in range(min(over, under))}
    best = np.zeros((len(doc) + 1, len(item) + 1), int)
    for p in range(len(doc)):
        for j in range(len(item)):
            best[p + 1, j + 1] = best[p, j] + 1 if (p, j) in cells else max(best[p, j + 1], best[p + 1, j])
    return best[-1, -1] / len(item)


def altered(rng, text, every):
    """A copy in which single words are changed, split, doubled or left out."""
    out = []
    for i, w in enumerate(text):
        r = rng.random()
        if i % every == every - 1 and r < 0.5:
            out.append("zz")
        elif r < 0.03:
            out += ["q", "q"]
        elif r < 0.05:
            continue
        else:
            out.append(w)
    return out


def coded(words_, known):
    return np.array([known.setdefault(w, len(known) + 1) for w in words_], np.int64)


def test_share_equals_brute_force():
    rng = random.Random(6)
    for n in range(120):
        item = [rng.choice(LEXICON[:rng.choice((4, 12, 60))]) for _ in range(rng.randrange(4, 40))]
        doc = altered(rng, item[rng.randrange(0, 4):], rng.choice((3, 5, 7)))
        doc = [rng.choice(LEXICON) for _ in range(rng.randrange(9))] + doc + rng.choice(([], item[:9], doc[::-1]))
        known: dict = {}
        i, d = coded(item, known), coded(doc, known)
        got, start, stop = held_share(d, i, 4)
        assert got == pytest.approx(brute_share(d, i)), (n, item, doc)
        assert 0 <= start <= stop <= len(doc)


@pytest.mark.parametrize("stock", [0, 3, 50])
def test_no_bridged_leak_is_lost_among_stock_documents(stock):
    rng = random.Random(stock)
    common = [[rng.choice(LEXICON) for _ in range(14)] for _ in range(6)]
    items = []
    for k in range(40):
        body = [f"own{k}x{i}" for i in range(rng.randrange(20, 60))]
        for part in rng.sample(common, 3):
            at = rng.randrange(len(body))
            body[at:at] = part
        items.append(body)
    block = Phrases([(f"i{k}", " ".join(t)) for k, t in enumerate(items)], 4, 0.4)
    shard, docs = Shard(), []
    for k, item in enumerate(items):
        for every in (4, 5, 6, 9):
            at = rng.randrange(len(item) // 2)
            docs.append(altered(rng, item[at:at + rng.randrange(len(item) * 2 // 5, len(item))], every))
    docs += [[w for _ in range(3) for w in rng.choice(common) + [rng.choice(LEXICON)]] for _ in range(stock)]
    for key, d in enumerate(docs):
        shard.put(key, words(" ".join(d)))
    shard.seal()
    got = {(d, name): part for d, name, part, _, _ in shard.leaks(block)}
    want = {}
    for d, codes in enumerate(shard.docs):
        for i, names in enumerate(block.names):
            item = np.array([shard.ids.get(w.encode(), -1) for w in items[i]], np.int64)
            part = held_share(codes, item, 4)[0]
            if part >= 0.4:
                want[d, names[0]] = part
    assert len(want) > 60
    assert got == want


@pytest.mark.parametrize("n", [40_000, 100_000])
def test_vocabulary_has_no_bound(n):
    rng = random.Random(n)
    size = n // 120
    items = [(f"i{k}", " ".join(f"w{k * 120 + i}" for i in range(120))) for k in range(size)]
    block = Phrases(items, 4, 0.4)
    assert len(block.vocabulary) > n - 120
    shard = Shard()
    for key, (_, text) in enumerate(items):
        half = text.split()[rng.randrange(60):][:60]
        shard.put(key, words(" ".join(half) + " some other words"))
    shard.seal()
    assert {(d, name) for d, name, *_ in shard.leaks(block)} == {(k, f"i{k}") for k in range(size)}


def test_repeated_phrases_do_not_explode():
    item = coded(["a", "b", "c", "d"] * 30, {})
    doc = np.tile(item[:4], 5_000)
    assert len(phrase_matches(doc, item, 4)[0]) > 500_000
    assert held_share(doc, item, 4)[0] == 1.0


def test_large_index_sorts_by_two_ranks():
    text = np.concatenate([np.arange(1, 2**21 + 5), [7, 8, 9, 0]])
    index = FMIndex(text, 2**21 + 4)
    low, high = index.search(np.array([[7, 8, 9], [8, 9, 10], [9, 8, 7]]))
    assert (high - low).tolist() == [2, 1, 0]
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == [6, 2**21 + 4]
