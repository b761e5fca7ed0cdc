import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import leakage
from tessella.llm.leakage import aligned, filter_of, find_leaks, holds, passing, respaced, segments, surroundings
from tessella.llm.letters import Laid

RNG = random.Random(12)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(3, 9))) for _ in range(3000)]


def prose(n, rng=RNG):
    return [rng.choice(VOCABULARY) for _ in range(n)]


ITEM = prose(60)
FORMULA = prose(8)


class Items:
    """The operator's steps without Spark."""

    def __init__(self, *texts, seen=None):
        self.held = [(words, *part.choose(seen)) for text in texts for words, part in segments(text)]
        prints = np.concatenate([c for _, _, covers in self.held for c in covers])
        self.marks, self.tiers = filter_of(prints, len(prints)), sorted({t for _, t, _ in self.held})

    def found(self, text):
        for _, doc, prints in surroundings([text], self.marks, self.tiers, 600, min(len(c) for _, _, c in self.held)):
            for words, _, covers in self.held:
                if all(np.isin(c, prints).any() for c in covers) and holds(words, doc):
                    return True
        return False


ITEMS = Items(" ".join(ITEM))


def held(words, items=ITEMS):
    return items.found(" ".join(words) if isinstance(words, list) else words)


def brute(item, doc):
    """Edit distance of every stretch of the item to any part of the document."""
    n, m = len(item), len(doc)
    for s in range(n - leakage.MIN_WORDS + 1):
        row = [0] * (m + 1)
        for i in range(s, n):
            new = [row[0] + 1]
            for j in range(m):
                new.append(min(row[j] + (item[i] != doc[j]), row[j + 1] + 1, new[j] + 1))
            row = new
            length = i - s + 1
            if length >= leakage.MIN_WORDS and min(row) <= length // leakage.ONE_IN:
                return True
    return False


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[at] = rng.choice(VOCABULARY)
        elif kind < 0.7:
            del words[at]
        else:
            words.insert(at, rng.choice(VOCABULARY))
    return words


@pytest.mark.parametrize("seed", range(60))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    length = rng.randint(14, 40)
    first = rng.randrange(60 - length + 1)
    stretch = edited(ITEM[first : first + length], rng.randint(0, length // 4), rng)
    doc = prose(rng.randint(0, 40), rng) + stretch + prose(rng.randint(0, 40), rng)
    assert aligned(ITEM, doc) == brute(ITEM, doc)
    assert held(doc) == brute(ITEM, doc)


def test_every_fifth_word_altered_is_found():
    stretch = [("x" + w if i % 5 == 4 else w) for i, w in enumerate(ITEM[:20])]
    assert held(prose(200) + stretch + prose(200))
    assert not held(prose(200) + [("x" + w if i % 4 == 3 else w) for i, w in enumerate(ITEM[:40])] + prose(200))


@pytest.mark.parametrize(
    "text",
    [
        " ".join(ITEM[5:27]).upper(),
        ", ".join(ITEM[5:27]),
        "\n".join(ITEM[5:27]),
        " ".join(w[:2] + chr(0xAD) + w[2:] for w in ITEM[5:27]),
        " ".join(w[:1] + chr(0x301) + w[1:] for w in ITEM[5:27]),
        " ".join(w[:2] + "-\n" + w[2:] if i % 3 == 0 else w for i, w in enumerate(ITEM[5:27])),
        " ".join(ITEM[5:15]) + " (Mr X [hear, hear]: " + " ".join(prose(12)) + ") [Applause.] " + " ".join(ITEM[15:27]),
        "(" + " ".join(ITEM[5:27]) + ")",
        "(unclosed " + " ".join(ITEM[5:27]) + " " + " ".join(prose(50)) + ")",
        " ".join(a + b for a, b in zip(ITEM[5:11:2], ITEM[6:12:2])) + " " + " ".join(ITEM[11:27]),
        # spacing
        " ".join(a + b for a, b in zip(ITEM[5:27:2], ITEM[6:28:2])),
        "".join(w + ("" if i % 3 == 2 else " ") for i, w in enumerate(ITEM[5:27])),
        "".join(ITEM[5:27]),
        " ".join(w[: len(w) // 2] + " " + w[len(w) // 2 :] if len(w) > 4 else w for w in ITEM[5:27]),
        " ".join(" ".join(w) for w in ITEM[5:27]),
        " ".join("-".join((w[:2], w[2:])) for w in ITEM[5:27]),
        # remarks of any length and nesting
        *(" ".join(ITEM[5:15]) + " [" + " ".join(prose(n)) + "] " + " ".join(ITEM[15:27]) for n in (40, 41, 60, 1000)),
        " ".join(ITEM[5:15]) + " (" + " (".join(" ".join(prose(6)) for _ in range(4)) + "))))" + " ".join(ITEM[15:27]),
        " ".join(prose(9)) + "(" + " ".join(prose(5)) + " " + " ".join(ITEM[5:15]) + " [so (it) is] " + " ".join(ITEM[15:27]) + " " + " ".join(prose(70)) + ")",
        " ".join(ITEM[5:12]) + " (" + " ".join(ITEM[12:20]) + ") " + " ".join(ITEM[20:27]),
        " ".join(f"[{w[0]}]{w[1:]}" for w in ITEM[5:27]),
        " ".join(ITEM[5:15]) + " (" + " ".join(prose(3)) + " [" + " ".join(prose(3)) + ") " + " ".join(ITEM[15:27]),
    ],
)
def test_what_makes_no_difference(text):
    assert held(" ".join(prose(30)) + " " + text + " " + " ".join(prose(30)))


@pytest.mark.parametrize("kind", ["joined", "gaps", "split", "spaced", "remark"])
def test_recall_of_altered_stretches_in_other_print(kind):
    """Stretches with as many alterations as may be, printed otherwise; each alteration stays one printed word."""
    rng, found = random.Random(kind), 0
    for _ in range(100):
        length = rng.randint(20, 40)
        first = rng.randrange(60 - length + 1)
        words = [rng.choice(VOCABULARY) if i % 5 == 4 and rng.random() < 0.9 else w for i, w in enumerate(ITEM[first : first + length])]
        text = {
            "joined": lambda: " ".join(a + b for a, b in zip(words[::2], words[1::2] + [""])),
            "gaps": lambda: "".join(w + ("" if i % 3 == 2 else " ") for i, w in enumerate(words)),
            "split": lambda: " ".join(w[:4] + " " + w[4:] if len(w) > 6 and w in ITEM else w for w in words),
            "spaced": lambda: " ".join(" ".join(w) for w in words),
            "remark": lambda: " ".join(words[:9]) + " (" + " ".join(prose(rng.randint(1, 300), rng)) + ") " + " ".join(words[9:]),
        }[kind]()
        found += held(" ".join(prose(30, rng)) + " " + text + " " + " ".join(prose(30, rng)))
    assert found >= 90


def test_respaced():
    item = "the old house stood near the river".split()
    assert respaced(item, "t h e o l d h o u s e stoodnear theriver".split()) == item
    assert respaced(item, "the old house fell near theriver".split()) == "the old house fell near the river".split()
    assert respaced(item, []) == []


def test_any_order_of_grams_finds_the_same():
    rng = np.random.default_rng(5)
    for seen in (None, rng.integers(0, 9, 1 << leakage.COUNTER_BITS), np.full(1 << leakage.COUNTER_BITS, 7)):
        items = Items(" ".join(ITEM), seen=seen)
        for seed in range(25):
            r = random.Random(seed)
            stretch = edited(ITEM[10:35], r.randint(3, 6), r)
            assert held(prose(20, r) + stretch + prose(20, r), items) == brute(ITEM, prose(0) + stretch)


def test_every_item_is_served():
    letters = [chr(97 + i % 26) for i in range(40)]
    for words in (letters, ["a"] * 30, [w[:2] for w in ITEM[:30]], ["ab"] * 10 + ITEM[:15]):
        assert held(prose(20) + words + prose(20), Items(" ".join(words)))
        altered = [("zzz" if i % 5 == 4 else w) for i, w in enumerate(words)]
        assert held(prose(20) + altered + prose(20), Items(" ".join(words)))


def test_filter():
    rng = np.random.default_rng(1)
    inside, outside = rng.integers(0, 2**64, 500, dtype=np.uint64), rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    marks = filter_of(inside, 500)
    assert len(passing(inside, marks)) == 500 and len(passing(outside, marks)) < 20


def test_short_quotations_and_formulas_are_no_case():
    assert not held(prose(30) + ITEM[:15] + prose(30))
    items = Items(" ".join(FORMULA + prose(30)), " ".join(prose(30) + FORMULA))
    assert not held(prose(10) + FORMULA + prose(10) + FORMULA, items)


def test_letters():
    laid = Laid(["Œuvre ﬁne STRASSE Straße L’été l'ete naïve soft" + chr(0xAD) + "ly bro-\n ken", "", "(un closed", "a (b [c] d) e (f)"])
    readings = [laid.words(a, b)[0] for a, b in zip(laid.firsts, laid.ends)]
    assert readings[0] == ["oeuvre", "fine", "strasse", "strasse", "lete", "lete", "naive", "softly", "broken"]
    assert readings[1:] == [[], ["un", "closed"], ["a", "b", "c", "d", "e", "f"], ["a", "e"], ["b", "d"]]
    assert laid.text.tolist() == [0, 1, 2, 3, 3, 3]


def test_letters_do_not_depend_on_the_batch():
    texts = [" ".join(prose(7)) + " (é [x] ﬁ) " * (i % 3) for i in range(20)]
    each = [w for t in texts for w in (lambda l: [l.words(a, b)[0] for a, b in zip(l.firsts, l.ends)])(Laid([t]))]
    laid = Laid(texts)
    assert sorted(map(str, each)) == sorted(str(laid.words(a, b)[0]) for a, b in zip(laid.firsts, laid.ends))


def test_operator(spark, monkeypatch):
    item = " ".join(ITEM)
    tests = spark.createDataFrame([(1, item), (2, " ".join(prose(40))), (3, None), (4, "too short"), (1, item)], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    docs = [(10, " ".join(prose(500) + ITEM[20:50] + prose(500))), (11, None), (12, ""), (13, " ".join(prose(100))), (10, item), (14, "x " * 300_000 + item + " y" * 300_000)]
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    expected = {(1, 10), (1, 14)}
    found = find_leaks(corpus, tests, "doc_id", "item_id")
    assert found.columns == ["item_id", "doc_id"] and sorted(map(tuple, found.collect())) == sorted(expected)
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(leakage, "BROADCAST_CHARS", 0)  # joined by shuffles
    assert {tuple(r) for r in find_leaks(corpus, tests, "doc_id", "item_id").collect()} == expected
    assert find_leaks(corpus.limit(0), tests, "doc_id", "item_id").count() == 0
    assert find_leaks(corpus, tests.limit(0), "doc_id", "item_id").count() == 0
    with pytest.raises(ValueError):
        find_leaks(corpus, corpus, "doc_id", "doc_id")
