"""Test passages inside a corpus, found by winnowed fingerprints and extended to edited stretches.

Fingerprints are grams of bare letters (:mod:`tessella.llm.letters`). Of a test
passage, those are chosen that the corpus seems to hold least often, as long as every
stretch that counts, with as many words altered as may be, must keep one of them
intact; this is proved for each passage by letting an adversary alter words as cheaply
as can be. The choice only decides how much is compared in vain. The corpus is read
once, whatever the number of passages: it leaves the surroundings of every place whose
gram may be a chosen one. Those are joined with the passages by fingerprint, and each
pair is aligned word by word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.runs import by_bytes
from tessella.llm.letters import Laid
from tessella.session import scratch_folder, spread

MIN_WORDS, ONE_IN = 20, 5
INTACT = MIN_WORDS - MIN_WORDS // ONE_IN
#: A stretch of twice ``MIN_WORDS`` words holds a shorter one, so none longer has to be sought.
LONGEST = 2 * MIN_WORDS - 1
MOST = LONGEST // ONE_IN
#: Letters that one altered or added word may have; a longer one counts as several.
WORD_LETTERS = 24
#: Letters in a gram, and grams in a window. A passage takes the first pair by which none of its
#: stretches can be missed; the last one serves any passage, for four words have four letters.
TIERS = ((8, 4), (5, 3), (3, 2))
#: Choices of grams, of each of which a document must hold one to be compared with a passage.
COVERS = 2
#: Words of one segment of a passage, and words it shares with the next, so that a stretch lies in one of them.
SEGMENT, SHARED = 160, LONGEST + 1
#: Documents from which the grams' frequencies are guessed, characters of them in one task and tasks, and bits of the counters.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, SAMPLE_TASKS, COUNTER_BITS = 4096, 1 << 22, 4, 20
#: Bits of the filter that chosen grams pass, so many for each of them and at most 64 MB.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 16, 29
#: Fingerprints that one task puts into a filter, and tasks at most.
FILTER_PRINTS, FILTER_TASKS = 1 << 20, 16
#: Rows of fingerprints, and characters of passages, that are broadcast; more of them are joined by shuffles in ``SALTS`` copies.
BROADCAST_ROWS, BROADCAST_CHARS, SALTS = 1 << 20, 1 << 24, 8
#: Characters of documents laid out at once.
SLICE = 1 << 18
#: Letters of a gram by which words are found again that are spaced in another way.
SHORT = 6


class _Stretches:
    """Tells which choices of grams no stretch of a passage can do without, whichever of its words are altered."""

    def __init__(self, words: np.ndarray, reach: int):
        """``words`` holds the letters of each word, ``reach`` those of a window."""
        self.n, self.reach = len(words), reach
        self.upto = np.concatenate([[0], np.cumsum(words)])
        self.never = self.n + LONGEST + 1
        self.checks = {a: np.arange(self.n - a * ONE_IN + 1) for a in range(MIN_WORDS // ONE_IN, MOST + 1) if self.n >= a * ONE_IN}

    def keep(self, chosen: np.ndarray) -> bool:
        """Does every stretch keep a chosen window whole? ``chosen`` are window numbers in ascending order.

        Altering the word that would complete the first chosen window since the last
        alteration is the cheapest way to keep none.
        """
        ends = np.append(chosen + self.reach, self.upto[-1] + 1)
        altered = np.searchsorted(self.upto[1:], ends)  # the word that completes each window
        altered[-1] = self.never
        fate = altered[np.searchsorted(chosen, self.upto)]  # for a run from each word on
        onward = np.minimum(fate + 1, self.n)
        since = np.arange(self.n + 1)
        for a in range(MOST + 1):
            starts = self.checks.get(a)
            if starts is not None and (fate[since[: len(starts)]] >= starts + a * ONE_IN).any():
                return False
            since = onward[since]
        return True


class Segment:
    """A segment of a test passage: its words and the fingerprints to look for."""

    def __init__(self, laid: Laid, reading: int, first: int, last: int, sizes: np.ndarray):
        self.laid, self.first, self.last, self.sizes = laid, first, last, sizes

    def choose(self, seen: np.ndarray | None) -> tuple[int, list[np.ndarray]]:
        """The tier, and the hashes of up to ``COVERS`` choices of grams, given how often grams were seen by their counters.

        Every stretch keeps a gram of each choice. For each, grams are given up from the
        most frequent on, as long as no stretch is missed that way.
        """
        for tier, (k, w) in enumerate(TIERS):
            h, _ = self.laid.grams(k)
            own = h[self.first : self.last - k + 1]
            if len(own) < w:
                continue
            kinds, kind = np.unique(np.lib.stride_tricks.sliding_window_view(own, w).min(axis=1), return_inverse=True)
            stretches = _Stretches(self.sizes, k + w - 1)
            left, covers = np.ones(len(kinds), bool), []
            times = seen[(kinds >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)] if seen is not None and tier == 0 else np.zeros(len(kinds), np.int64)
            order = np.argsort(-times, kind="stable")
            while len(covers) < COVERS and stretches.keep(np.flatnonzero(left[kind])):
                chosen, candidates = left.copy(), order[left[order]]
                at, size = 0, len(candidates)
                while at < len(candidates):
                    part = candidates[at : at + size]
                    chosen[part] = False
                    if stretches.keep(np.flatnonzero(chosen[kind])):
                        at, size = at + len(part), 2 * size
                    else:
                        chosen[part] = True
                        at, size = (at + 1, 1) if len(part) == 1 else (at, len(part) // 2)
                covers.append(kinds[chosen])
                left &= ~chosen
            if covers:
                return tier, covers
        raise AssertionError("the last tier serves every passage")


def segments(text: str) -> list[tuple[str, Segment]]:
    """The words (parted by blanks) of each segment of each reading of a passage."""
    laid = Laid([text])
    out = []
    for r, (first, last) in enumerate(zip(laid.firsts.tolist(), laid.ends.tolist())):
        words, starts = laid.words(first, last)
        at = 0
        while len(words) - at >= MIN_WORDS:
            part = words[at : at + SEGMENT]
            a = first + int(starts[at])
            b = first + (int(starts[at + SEGMENT]) if at + SEGMENT < len(words) else last - first)
            out.append((" ".join(part), Segment(laid, r, a, b, np.fromiter(map(len, part), np.int64))))
            if at + SEGMENT >= len(words):
                break
            at += SEGMENT - SHARED
    return out


def counters(texts: Sequence[str]) -> np.ndarray:
    """How often a gram of each counter occurs in the texts."""
    laid = Laid(texts)
    h, whole = laid.grams(TIERS[0][0])
    return np.bincount((h[whole] >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=1 << COUNTER_BITS)


def _places(h: np.ndarray, bits: int, turn: int) -> np.ndarray:
    if turn:
        h = h * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[turn - 1])
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def filter_of(h: np.ndarray, n: int) -> np.ndarray:
    """A filter, of a size fit for ``n`` hashes, that these hashes pass; filters of one size are united by ``|``."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n).bit_length()))
    marks = np.zeros(1 << (bits - 3), np.uint8)
    for turn in range(3):
        place = _places(h, bits, turn)
        np.bitwise_or.at(marks, place >> 3, (1 << (place & 7)).astype(np.uint8))
    return marks


def passing(h: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The places of the hashes that pass a filter: all that are in it, and few others as long as it is not full."""
    bits = len(marks).bit_length() + 2
    at = None
    for turn in range(3):
        place = _places(h if at is None else h[at], bits, turn)
        held = np.flatnonzero(marks[place >> 3] >> (place & 7).astype(np.uint8) & 1)
        at = held if at is None else at[held]
    return at


def surroundings(texts: Sequence[str], marks: np.ndarray, tiers: Sequence[int], reach: int, least: int) -> Iterator[tuple[int, str, np.ndarray]]:
    """(text, words, kept grams that may be chosen ones) around each such gram of each reading of the texts.

    ``marks`` is a filter of the chosen grams (see :func:`passing`). ``reach`` is the
    number of letters that a stretch may take to either side; overlapping surroundings are
    put together up to a few times that length, so that each gram has its own around it.
    Those with fewer than ``least`` different grams are left out, and those that another
    reading holds as they are.
    """
    laid = Laid(texts)
    found = []
    for tier in tiers:
        k, w = TIERS[tier]
        h, whole = laid.grams(k)
        at = passing(h, marks)
        at = at[whole[at]]
        at = at[laid.kept(h, whole, at, w)]
        found.append((at, h[at], np.full(len(at), k)))
    at, h, k = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(at, kind="stable")
    at, h, k = at[order], h[order], k[order]
    reading = laid.reading_of(at)
    lo, hi = np.maximum(laid.firsts[reading], at - reach), np.minimum(laid.ends[reading], at + k + reach)
    i = 0
    while i < len(at):
        j = i + 1
        while j < len(at) and lo[j] < hi[j - 1] and hi[j] - lo[i] <= 4 * reach:  # never across readings, whose ranges do not meet
            j += 1
        end = int(hi[i:j].max())
        prints = np.unique(h[np.searchsorted(at, lo[i]) : np.searchsorted(at, end)])
        if len(prints) >= least and not laid.repeats(int(lo[i]), end):
            yield int(laid.text[reading[i]]), " ".join(laid.words(int(lo[i]), end)[0]), prints
        i = j


def respaced(item: Sequence[str], doc: Sequence[str]) -> list[str]:
    """``doc`` parted into words as ``item`` is, wherever the letters of both run alike.

    What remains between such runs keeps its own words; letters that stand alone there
    are taken together as one word.
    """
    a, b = "".join(item), "".join(doc)
    if len(a) < SHORT or len(b) < SHORT:
        return list(doc)
    places = {a[i : i + SHORT]: i for i in range(len(a) - SHORT, -1, -1)}
    ends_item = np.cumsum([len(w) for w in item]).tolist()
    begins = dict(zip([0, *ends_item[:-1]], range(len(item))))
    cuts: list[int] = []  # letters of the document at which one of the item's words begins or ends
    inner: set[int] = set()  # letters within such words, at which no word may begin
    j = 0
    while j <= len(b) - SHORT:
        i = places.get(b[j : j + SHORT])
        if i is None:
            j += 1
            continue
        size = SHORT
        while i + size < len(a) and j + size < len(b) and a[i + size] == b[j + size]:
            size += 1
        for first in range(i, i + size):
            w = begins.get(first)
            if w is not None and first + len(item[w]) <= i + size:
                start = j + first - i
                cuts += (start, start + len(item[w]))
                inner.update(range(start + 1, start + len(item[w])))
        j += size - SHORT + 1
    printed = np.concatenate([[0], np.cumsum([len(w) for w in doc])]).tolist()
    single = {p for p, q in zip(printed, printed[1:]) if q - p == 1}
    kept = set(cuts)
    marks = sorted(kept | {p for p in printed if p not in inner and not (p in single and p - 1 in single and p not in kept)} | {0, len(b)})
    return [b[p:q] for p, q in zip(marks, marks[1:])]


def aligned(item: Sequence[str], doc: Sequence[str]) -> bool:
    """Does ``doc`` hold a stretch of ``item``, as stated for :func:`find_leaks`?

    For every first word of a stretch, one row holds the fewest alterations with which
    the item's words so far end at each place of the document. A word written as two,
    or two as one, is no alteration, for spacing makes no difference.
    """
    n, m = len(item), len(doc)
    if n < MIN_WORDS or m == 0:
        return False
    places: dict[str, list[int]] = {}
    for j, w in enumerate(doc):
        places.setdefault(w, []).append(j)
    joined = {(doc[j - 1] + doc[j]): j for j in range(m - 1, 0, -1)}
    pairs: dict[str, list[int]] = {w: [j for j in range(1, m) if doc[j - 1] + doc[j] == w] for w in set(item) & joined.keys()}
    starts = n - MIN_WORDS + 1
    kind = np.int16 if n + m < 1 << 14 else np.int32
    steps = np.arange(m + 1, dtype=kind)
    now = np.zeros((starts, m + 1), kind)
    before = now
    for i, word in enumerate(item):
        s = min(i + 1, starts)
        old = now[:s]
        differs = np.ones(m, kind)
        differs[places.get(word, [])] = 0
        new = old + 1
        np.minimum(new[:, 1:], old[:, :-1] + differs, out=new[:, 1:])
        if i:
            s2 = min(i, starts)
            for j in places.get(item[i - 1] + word, ()):
                new[:s2, j + 1] = np.minimum(new[:s2, j + 1], before[:s2, j])
        for j in pairs.get(word, ()):
            new[:, j + 1] = np.minimum(new[:, j + 1], old[:, j - 1])
        new = np.minimum.accumulate(new - steps, axis=1) + steps
        length = i + 1 - np.arange(s)
        long = np.flatnonzero(length >= MIN_WORDS)
        if len(long) and (new[long].min(axis=1) <= length[long] // ONE_IN).any():
            return True
        before = now
        now = np.zeros((starts, m + 1), kind)
        now[:s] = new
    return False


def in_step(item: np.ndarray, doc: np.ndarray) -> bool:
    """Is a stretch plain to see where item and document run in step, word for word? (False says nothing.)"""
    i, j = np.nonzero(item[:, None] == doc[None, :])
    if not len(i):
        return False
    shift = np.bincount(j - i + len(item))
    best = int(shift.argmax())
    if shift[best] < INTACT:
        return False
    same = np.zeros(len(item) + 1, np.int64)
    same[1 + i[j - i + len(item) == best]] = 1
    upto = np.cumsum(same)
    return bool((upto[MIN_WORDS:] - upto[:-MIN_WORDS] >= INTACT).any())


def _numbers(words: Sequence[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _neighbours(numbers: np.ndarray) -> np.ndarray:
    return numbers[:-1] * np.uint64(0x9E3779B97F4A7C15) + numbers[1:]


def _short_grams(letters: str) -> np.ndarray:
    c = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(c) - SHORT + 1)
    h = np.zeros(n, np.uint64)
    for i in range(SHORT):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += c[i : i + n]
    return h


class _Place:
    """Words, their short grams, and how these are parted into words (a bit for each letter that begins a word)."""

    def __init__(self, words: str):
        self.words = words.split(" ")
        self.grams = _short_grams(words.replace(" ", ""))
        sizes = np.fromiter(map(len, self.words), np.int64)
        self.upto = np.cumsum(sizes)
        self.parted = np.zeros(int(self.upto[-1]), np.uint8)
        self.parted[(self.upto - sizes)[sizes > 0]] = 1
        self.parts = np.zeros(len(self.grams), np.uint8)
        for i in range(1, SHORT):
            self.parts |= self.parted[i : i + len(self.grams)] << i


class _Passage:
    """A segment's words as needed for comparing it with documents."""

    def __init__(self, words: str):
        self.words = words.split(" ")
        self.ids = _numbers(self.words)
        self.pairs = np.unique(_neighbours(self.ids))
        here = _Place(words)
        self.grams, first = np.unique(here.grams, return_index=True)
        self.parts = here.parts[first]
        #: (grams that a stretch of so many words keeps at least, letters that it takes at most)
        self.least: list[tuple[int, int]] = []
        sizes = np.fromiter(map(len, self.words), np.int64)
        longest = int(max(sizes.max(), WORD_LETTERS))
        for a in range(MIN_WORDS // ONE_IN, MOST + 1):
            if len(sizes) >= a * ONE_IN:
                windows = np.lib.stride_tricks.sliding_window_view(sizes, a * ONE_IN)
                intact = np.sort(windows, axis=1)[:, : a * (ONE_IN - 1)].sum(axis=1)
                span = np.lib.stride_tricks.sliding_window_view(sizes, min(len(sizes), a * ONE_IN + ONE_IN - 1)).sum(axis=1).max()
                self.least.append((int(intact.min()) - (a + 1) * (SHORT - 1), int(span) + a * longest))

    def region(self, doc: _Place) -> tuple[int, int, bool] | None:
        """The letters of a document among which a stretch may be, by the short grams it shares with the passage.

        Also, whether any of these grams is parted into words in another way there.
        """
        if not len(self.grams) or not len(doc.grams):
            return (0, len(doc.parted), True) if self.least[0][0] <= 0 else None
        place = np.searchsorted(self.grams, doc.grams)
        place[place == len(self.grams)] = 0
        same = self.grams[place] == doc.grams
        if np.count_nonzero(same) < min(least for least, _ in self.least):
            return None
        upto = np.concatenate([[0], np.cumsum(same)])
        lo, hi = len(doc.parted), 0
        for least, span in self.least:
            if least <= 0:
                lo, hi = 0, len(doc.parted)
                break
            width = min(span, len(same))
            starts = np.flatnonzero(upto[width:] - upto[: len(upto) - width] >= least)
            if len(starts):
                lo, hi = min(lo, int(starts[0])), max(hi, int(starts[-1]) + span)
        if lo >= hi:
            return None
        at = np.flatnonzero(same[lo:hi]) + lo
        return lo, hi, bool((doc.parts[at] != self.parts[place[at]]).any())

    def dense(self, words: Sequence[str]) -> bool:
        """Do as many pairs of neighbouring words agree, close together, as a stretch must leave intact?"""
        pairs = _neighbours(_numbers(words))
        place = np.searchsorted(self.pairs, pairs)
        place[place == len(self.pairs)] = 0
        upto = np.concatenate([[0], np.cumsum(self.pairs[place] == pairs)])
        for a in range(MIN_WORDS // ONE_IN, MOST + 1):
            width = min(a * ONE_IN + a - 1, len(pairs))
            if len(pairs) and (upto[width:] - upto[: len(upto) - width]).max() >= a * (ONE_IN - 2) - 1:
                return True
        return False


_passage = lru_cache(maxsize=4096)(_Passage)


_place = lru_cache(maxsize=4096)(_Place)


def holds(item: str, doc: str) -> bool:
    """Do the words ``doc`` hold a stretch of the words ``item`` (both parted by blanks)?"""
    passage, place = _passage(item), _place(doc)
    region = passage.region(place)
    if region is None:
        return False
    lo, hi, otherwise = region
    printed = place.words[max(0, int(np.searchsorted(place.upto, lo)) - 1) : int(np.searchsorted(place.upto, hi)) + 2]
    if in_step(passage.ids, _numbers(printed)):
        return True
    if not otherwise:
        return passage.dense(printed) and aligned(passage.words, printed)
    again = respaced(passage.words, printed)
    return any(passage.dense(words) and aligned(passage.words, words) for words in ([again] if again == printed else [again, printed]))


def find_leaks(corpus: DataFrame, tests: DataFrame, doc_id: str, item_id: str, text: str = "text") -> DataFrame:
    """(``item_id``, ``doc_id``): every document that holds a stretch of a test item, with each item it holds.

    A stretch is at least ``MIN_WORDS`` words in a row of the item, in order, of which at
    most one in ``ONE_IN`` is altered, missing or added in the document. Case, accents,
    joined letters, punctuation, spacing, invisible characters, line layout and
    bracketed remarks, of any length and nesting, make no difference. Each pair comes
    once, also where rows are repeated. Null and empty texts, and items of fewer words,
    give no pair. Other columns are not read; ``item_id`` and ``doc_id`` must differ. An
    empty table on either side gives no rows.

    The corpus is read once by ``mapInArrow``, without a shuffle; candidates, fingerprints
    and passages are written to the shared scratch folder and joined.
    """
    if item_id == doc_id:
        raise ValueError("the two identifiers need different names")
    spark = corpus.sparkSession
    documents = corpus.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL")
    passages = tests.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL").distinct()

    segment = _written(spark, _segments(passages, _seen(documents)).withColumn("s", F.monotonically_increasing_id()), "segments")
    prints = segment.select("s", "covers", F.posexplode("h").alias("cover", "hs")).select("s", "covers", F.expr("shiftleft(1, cover)").alias("cover"), F.explode("hs").alias("h"))
    size = segment.agg(
        F.count(F.lit(1)), F.sum(F.size(F.flatten("h"))), F.sum(F.length("words")), F.max("reach"), F.collect_set("tier"), F.min("covers")
    ).first()
    n_segments, n_prints, n_chars, reach, tiers, covers = size
    schema = T.StructType([tests.schema[item_id], corpus.schema[doc_id]])
    if not n_segments:
        return spark.createDataFrame([], schema)

    places = _written(spark, _surroundings(spread(documents), _marks(prints, n_prints), sorted(tiers), reach, covers).withColumn("p", F.monotonically_increasing_id()), "places")
    hits = places.select("p", F.explode("h").alias("h"))
    pairs = _joined(hits, prints, "h", "p", n_prints <= BROADCAST_ROWS).groupBy("p", "s").agg(F.bit_or("cover").alias("met"), F.first("covers").alias("covers"))
    pairs = pairs.where(F.bit_count("met") == F.col("covers")).select("p", "s")
    pairs = pairs.join(places.select("p", "d", F.col("words").alias("doc")), "p")
    pairs = _joined(pairs, segment.select("s", "i", F.col("words").alias("item")), "s", "p", n_chars <= BROADCAST_CHARS)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [holds(i, d) for i, d in zip(batch.column("item").to_pylist(), batch.column("doc").to_pylist())]
            yield batch.select(["i", "d"]).filter(pa.array(held, pa.bool_()))

    # few rows of much work each, so they are spread over all tasks; pairs of one place stay together
    found = pairs.select("p", "i", "d", "item", "doc").repartition(tasks, "p").mapInArrow(verify, T.StructType([pairs.schema["i"], pairs.schema["d"]]))
    return found.distinct().select(F.col("i").alias(item_id), F.col("d").alias(doc_id))


def _written(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    path = scratch_folder(spark, f"leaks-{name}")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _joined(large: DataFrame, small: DataFrame, on: str, salt: str, broadcast: bool) -> DataFrame:
    """An inner join in which no value of ``on`` is left to one task, however often ``large`` holds it."""
    if broadcast:
        return large.join(F.broadcast(small), on)  # of a size that was counted
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return large.withColumn("__salt", F.pmod(F.col(salt), F.lit(SALTS)).cast("int")).join(salted, [on, "__salt"]).drop("__salt")


def _seen(documents: DataFrame) -> np.ndarray | None:
    """Counters of grams from a bounded number of documents; what they say only orders the grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chars = np.zeros(1 << COUNTER_BITS, np.int64), 0
        for batch in batches:
            for part in by_bytes(batch, "t", SLICE):
                texts = [t[: SAMPLE_CHARS - chars] for t in part.column("t").to_pylist()]
                chars += sum(map(len, texts))
                total += counters(texts)
                if chars >= SAMPLE_CHARS:
                    break
            if chars >= SAMPLE_CHARS:
                break
        yield pa.RecordBatch.from_arrays([pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())], names=["c"])

    rows = documents.select("t").limit(SAMPLE_DOCUMENTS).repartition(SAMPLE_TASKS).mapInArrow(run, "c binary").collect()  # a row of 4 MB from each task
    return sum(np.frombuffer(r["c"], np.int32).astype(np.int64) for r in rows) if rows else None


def _segments(passages: DataFrame, seen: np.ndarray | None) -> DataFrame:
    """(i, words, tier, covers, h, reach) for each segment of each passage."""
    held = passages.sparkSession.sparkContext.broadcast(seen)  # 4 MB
    schema = T.StructType(
        [passages.schema["i"], T.StructField("words", T.StringType()), T.StructField("tier", T.IntegerType()), T.StructField("covers", T.IntegerType()), T.StructField("h", T.ArrayType(T.ArrayType(T.LongType(), False), False)), T.StructField("reach", T.IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, words, tiers, prints, reaches = [], [], [], [], []
            for r, text in enumerate(batch.column("t").to_pylist()):
                for joined, segment in segments(text):
                    tier, covers = segment.choose(held.value)
                    longest = int(max(segment.sizes.max(), WORD_LETTERS))
                    letters = np.convolve(segment.sizes, np.ones(min(LONGEST, len(segment.sizes)), np.int64)).max()
                    row.append(r)
                    words.append(joined)
                    tiers.append(tier)
                    prints.append([c.view(np.int64).tolist() for c in covers])
                    reaches.append(int(letters) + MOST * longest)
            number = pa.field("element", pa.int64(), nullable=False)
            lists = pa.array(prints, pa.list_(pa.field("element", pa.list_(number), nullable=False)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("i").take(pa.array(row, pa.int64())), pa.array(words, pa.string()), pa.array(tiers, pa.int32()), pa.array([len(p) for p in prints], pa.int32()), lists, pa.array(reaches, pa.int32())],
                names=schema.names,
            )

    return passages.repartition(passages.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)


def _marks(prints: DataFrame, n: int) -> np.ndarray:
    """A filter that all fingerprints pass, of at most 2**MOST_BITS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = filter_of(np.zeros(0, np.uint64), n)
        for batch in batches:
            marks |= filter_of(batch.column("h").to_numpy().view(np.uint64), n)
        yield pa.RecordBatch.from_arrays([pa.array([pa.Codec("zstd").compress(marks.tobytes(), asbytes=True)], pa.binary())], names=["m"])

    total = filter_of(np.zeros(0, np.uint64), n)
    for row in prints.select("h").coalesce(min(FILTER_TASKS, 1 + n // FILTER_PRINTS)).mapInArrow(run, "m binary").toLocalIterator():  # one filter at a time
        total |= np.frombuffer(pa.Codec("zstd").decompress(row["m"], len(total)), np.uint8)
    return total


def _surroundings(documents: DataFrame, marks: np.ndarray, tiers: Sequence[int], reach: int, least: int) -> DataFrame:
    """(d, words, h) for each place of the documents that may hold a fingerprint."""
    held = documents.sparkSession.sparkContext.broadcast(marks)  # at most 2**MOST_BITS bits
    schema = T.StructType([documents.schema["d"], T.StructField("words", T.StringType()), T.StructField("h", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "t", SLICE):
                found = list(surroundings(part.column("t").to_pylist(), held.value, tiers, reach, least))
                if found:
                    row, words, prints = zip(*found)
                    lists = pa.array([p.view(np.int64).tolist() for p in prints], pa.list_(pa.field("element", pa.int64(), nullable=False)))
                    yield pa.RecordBatch.from_arrays([part.column("d").take(pa.array(row, pa.int64())), pa.array(words, pa.string()), lists], names=schema.names)

    return documents.mapInArrow(run, schema)
