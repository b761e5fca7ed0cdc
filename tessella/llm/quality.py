"""Figures that tell running prose from lists, tables and junk, and fixed rules over them.

The figures come from column kernels over batches of whole texts: words and lines are
split, flagged and summed for all documents of a batch at once. The rules are plain
column expressions with fixed thresholds, those of Rae et al. (2021, "Scaling Language
Models", table A1) among them, and every rule that fails a document is recorded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.runs import by_bytes
from tessella.session import spread

#: Frequent function words of English, German and French.
COMMON = {
    "en": "about after all also although an and any are as at be because been before being but by can cannot could did do does every for from had has have he her here his how if in into is it its just may me more most must my no nobody not of on once only or other our out over own rather really shall she should so some such than that the their them then there these they this those though to under unless until up upon us very was we were what when where whereas whether which while who whose why will with within without would yet you your",
    "de": "aber als am auch auf aus bei bis da das dass dem den der des die dieser diesem dieses ein eine einem einen einer eines er es für haben hat heute hier ich ihr im ist ja kein keine man mehr mein mit nach nicht niemand noch nur ob oder ohne schon sein seit sich sie sind so über um und uns unser unsere unter viel vom von vor war was wenn wer wie wir wird zu zum zur zwischen",
    "fr": "à au aux avec bien ce cela ces cet cette comme dans de depuis des donc du elle en encore est et eu il ils je la le les leur longtemps mais même mon ne nos notre nous on ont ou où par pas personne plus pour qu que qui sa sans se ses si son sont sous sur toujours tous tout très un une vos votre vous ici",
}
WORDS = sorted({w for words in COMMON.values() for w in words.split()})
#: The eight English stop words of the published rule.
STOP = ["the", "be", "to", "of", "and", "that", "have", "with"]

# the patterns hold for RE2, in which both this module and the SQL run them
INVISIBLE = r"[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]"
SPACE = r"[\pZ\s]"
TOKEN = r"[^\pZ\s]+"
EDGES = r"^[^\pL\pM\pN_]+|[^\pL\pM\pN_]+$"
PLAIN = r"^[\pL\pM]+(?:[-'’][\pL\pM]+)*$"
PIECES = r"[-'’]"
BULLET = rf"^{SPACE}*(?:[-–—*•·>‣▪◦]|\(?(?:[0-9]{{1,3}}|[ivxIVX]{{1,5}}|[a-zA-Z])[.)]|[A-Z]{{2,5}} ?[:=–-]){SPACE}"
SENTENCE_END = rf"[.!?…][\"”“’'»)\]]*{SPACE}*$"
ELLIPSIS_END = rf"(?:\.\.\.|…){SPACE}*$"
SYMBOLS = r"#|\.\.\.|…"

FIGURES = {
    "n_words": T.LongType(),
    "n_lines": T.LongType(),
    "mean_word_length": T.DoubleType(),
    "symbol_ratio": T.DoubleType(),
    "letter_word_share": T.DoubleType(),
    "plain_word_share": T.DoubleType(),
    "common_word_share": T.DoubleType(),
    "n_stop_words": T.LongType(),
    "top_word_share": T.DoubleType(),
    "distinct_word_share": T.DoubleType(),
    "final_punctuation_share": T.DoubleType(),
    "ellipsis_line_share": T.DoubleType(),
    "bullet_line_share": T.DoubleType(),
    "item_word_share": T.DoubleType(),
    "words_per_item": T.DoubleType(),
}


def _flag(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False)


def _split(texts: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, and the text each belongs to."""
    lists = pc.split_pattern_regex(texts, pattern)
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    return lists.flatten(), owner


def figures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The figures of each text; null counts as empty, and a share of nothing is 0."""
    n = len(texts)
    texts = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.string()), ""), INVISIBLE, "")
    tokens, owner = _split(texts, f"{SPACE}+")
    some = pc.greater(pc.binary_length(tokens), 0)
    tokens, owner = tokens.filter(some), owner[some.to_numpy(zero_copy_only=False)]
    coded = tokens.dictionary_encode()
    code, kinds = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    bare = pc.replace_substring_regex(pc.utf8_lower(kinds), EDGES, "")
    pieces, piece_of = _split(bare, PIECES)
    plain = _flag(bare, PLAIN)
    common = np.zeros(len(kinds), bool)
    common[piece_of[pc.is_in(pieces, pa.array(WORDS)).to_numpy(zero_copy_only=False)]] = True

    def total(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=flags, minlength=n)

    def words(per_kind: np.ndarray) -> np.ndarray:
        return total(per_kind[code], owner)

    n_words = np.bincount(owner, minlength=n)
    again = bare.dictionary_encode()
    word = again.indices.to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, np.int64)
    width = len(again.dictionary) + 1
    used, times = np.unique(owner * width + word, return_counts=True)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, used // width, times)
    stop_code = pc.index_in(again.dictionary, pa.array(STOP)).to_numpy(zero_copy_only=False)
    stops = np.bincount((used // width)[~np.isnan(stop_code.astype(float))[used % width]], minlength=n)

    lines, line_of = _split(texts, "\n")
    filled = pc.match_substring_regex(lines, r"[^\pZ\s]")
    lines, line_of = lines.filter(filled), line_of[filled.to_numpy(zero_copy_only=False)]
    n_lines = np.bincount(line_of, minlength=n)
    ends, bullet = _flag(lines, SENTENCE_END), _flag(lines, BULLET)
    item = bullet & ~ends
    line_words = pc.count_substring_regex(lines, TOKEN).to_numpy(zero_copy_only=False)
    n_items, item_words = total(item, line_of), total(np.where(item, line_words, 0), line_of)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.divide(part, whole, out=np.zeros(n), where=whole > 0)

    return {
        "n_words": n_words,
        "n_lines": n_lines,
        "mean_word_length": share(words(pc.utf8_length(kinds).to_numpy(zero_copy_only=False)), n_words),
        "symbol_ratio": share(pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False), n_words),
        "letter_word_share": share(words(_flag(kinds, r"\pL")), n_words),
        "plain_word_share": share(words(plain), n_words),
        "common_word_share": share(words(plain & common), n_words),
        "n_stop_words": stops,
        "top_word_share": share(top, n_words),
        "distinct_word_share": share(np.bincount(used // width, minlength=n), n_words),
        "final_punctuation_share": share(total(ends, line_of), n_lines),
        "ellipsis_line_share": share(total(_flag(lines, ELLIPSIS_END), line_of), n_lines),
        "bullet_line_share": share(total(bullet, line_of), n_lines),
        "item_word_share": share(item_words, n_words),
        "words_per_item": share(item_words, n_items),
    }


def text_figures(df: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """(``doc_id``, figures): one row per row of ``df``, from its whole text, in one pass without a shuffle.

    A null or blank text has no words and shares of 0. Repeated rows are judged each;
    an empty table gives no rows; other columns are not read. ``doc_id`` must not bear
    the name of a figure.
    """
    if doc_id in FIGURES:
        raise ValueError("the identifier bears the name of a figure")
    schema = T.StructType([df.schema[doc_id], *(T.StructField(k, v) for k, v in FIGURES.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "__text"):
                of = figures(part.column(1))
                columns = [pa.array(of[k], pa.int64() if k.startswith("n_") else pa.float64()) for k in FIGURES]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[doc_id, *FIGURES])

    return spread(df.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").alias("__text"))).mapInArrow(run, schema)


#: Rules by name, as SQL over the figures; a text fails a rule where it holds. These are the published ones,
#: most of which judge length, figures and layout as well.
PUBLISHED = {
    "word_count": "n_words < 50 OR n_words > 100000",
    "mean_word_length": "mean_word_length < 3 OR mean_word_length > 10",
    "symbols": "symbol_ratio > 0.1",
    "bullet_lines": "bullet_line_share > 0.9",
    "ellipsis_lines": "ellipsis_line_share > 0.3",
    "letter_words": "letter_word_share < 0.8",
    "stop_words": "n_stop_words < 2",
}
#: Rules against texts whose words form no sentences; none of them looks at length, figures or layout alone.
RUNNING = {
    "few_plain_words": "plain_word_share < 0.5 AND n_words > 0",
    "few_common_words": "common_word_share < 0.22 AND (n_words >= 30 OR n_words >= 20 AND final_punctuation_share < 0.5)",
    "one_word_repeated": "top_word_share > 0.3 AND n_words >= 10",
    "few_different_words": "common_word_share < 0.35 AND final_punctuation_share < 0.2 AND (distinct_word_share < 0.4 AND n_words BETWEEN 20 AND 200 OR distinct_word_share < 0.6 AND n_words BETWEEN 20 AND 60)",
    "endless_words": "mean_word_length > 15",
    "list_items": "item_word_share >= 0.5 AND words_per_item <= 15 AND (common_word_share < 0.32 OR words_per_item <= 6.5)",
}


def failed_rules(rules: dict[str, str]) -> Column:
    """The names of the rules that fail a row of figures, in their order."""
    return F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items())))
