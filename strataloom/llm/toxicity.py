"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases.

Text is folded first: case, look-alike letters of other scripts and digits or signs used as letters. A lexicon of word
stems with weights is learned from labelled rows, on top of a few seed words; one automaton holds stems and exception
phrases. A stem counts where a word begins; what an exception phrase covers doesn't count. The score is a logistic
function of the weight found per word of the text and of how often stems were found.

Defined cases: null, empty and wordless texts have no hits and get the score of such a text (under 0.5); a null id stays
null and belongs to the learning part of no row (it is never learned from); repeated rows get equal scores; without any
labelled row of both classes the seed words and default coefficients are used.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import crc_fold, pick

# Letters of other scripts that look like Latin ones, and digits and signs used as letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ո": "n",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ɑ": "a", "ɡ": "g", "ı": "i",
}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# Seed words of the lexicon and phrases in which they are harmless.
SEEDS = ["idiot", "moron", "stupid", "loser", "scum", "clown", "trash", "pathetic", "disgusting", "worthless", "imbecile", "dumbass", "bastard", "asshole", "retard", "vermin", "filthy", "degenerate"]
EXCEPTIONS = ["clown fish", "circus clown", "rodeo clown", "class clown", "trash can", "trash bin", "trash bag", "pond scum", "soap scum", "idiot proof", "idiot light", "sore loser"]

_SIGNS = re.compile(r"[0134578@$!]+")
_WORD = re.compile(r"[^\W\d_]+")
_HOMO = str.maketrans(HOMOGLYPHS)
_LEET = str.maketrans(LEET)
_FULLWIDTH = {c: chr(c - 0xFEE0).lower() for c in range(0xFF01, 0xFF5F)}
_ODD = frozenset(HOMOGLYPHS) | frozenset(map(chr, _FULLWIDTH))


def _as_letters(m: re.Match) -> str:
    """Digits and signs become letters between two letters, or one of them before two letters that start no digit run."""
    text, start, end = m.string, m.start(), m.end()
    after = text[end : end + 1].isalpha()
    if after and start and text[start - 1].isalpha():
        return m[0].translate(_LEET)
    if after and end - start == 1 and m[0] != "!" and text[end + 1 : end + 2].isalpha() and not (start and text[start - 1].isalnum()):
        return m[0].translate(_LEET)
    return m[0]


def fold(text: str) -> str:
    """Lower case, look-alikes as Latin letters in words that have Latin letters, digits and signs inside words as letters."""
    text = text.lower()
    if not text.isascii() and not _ODD.isdisjoint(text):
        text = text.translate(_FULLWIDTH)
        text = re.sub(r"\w*[a-z]\w*", lambda m: m[0] if m[0].isascii() else m[0].translate(_HOMO), text)
    return _SIGNS.sub(_as_letters, text)


@dataclass
class Lexicon:
    """weights: of each stem; coefficients: of the logistic function over features()."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    coefficients: tuple[float, ...] = (-2.5, 1.0, 0.8, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for stem, weight in self.weights.items():
            found.add_word(stem, (len(stem), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found


def measure(folded: str, automaton: ahocorasick.Automaton) -> tuple[float, int]:
    """Total weight and number of hits: for each word start the longest stem, none inside an exception phrase."""
    best: dict[int, tuple[int, float]] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(folded) if len(automaton) else ():
        start = end - length + 1
        if start and folded[start - 1].isalpha():
            continue
        if weight is None:
            if end + 1 == len(folded) or not folded[end + 1].isalpha():
                excused.append((start, end + 1))
        elif length > best.get(start, (0,))[0]:
            best[start] = (length, weight)
    if excused:
        best = {s: v for s, v in best.items() if not any(a <= s < b for a, b in excused)}
    return sum(w for _, w in best.values()), len(best)


def features(text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, ...]:
    """1, weight per 100 words (damped), log hits, log words."""
    folded = fold(text or "")
    weight, hits = measure(folded, automaton)
    words = len(folded.split())
    return 1.0, float(np.log1p(100.0 * max(weight, 0.0) / max(words, 1))), float(np.log1p(hits)), float(np.log1p(words)) * (hits > 0)


def learn(texts: list[str], toxic: list[int], min_docs: int | None = None, max_stems: int = 400, stem_lengths: tuple[int, int] = (3, 10)) -> Lexicon:
    """Stems whose rate per word in toxic texts is well above that in others, then the logistic coefficients.

    min_docs: different toxic texts that must have a stem; by default a twelfth of them, at least 3, at most 12.
    """
    texts, label = [fold(t or "") for t in texts], np.asarray(toxic, float)
    if not len(label) or label.min() == label.max():
        return Lexicon({w: 3.0 for w in SEEDS})
    counts: tuple[dict, dict] = ({}, {})
    docs: dict[str, int] = {}
    words = [1, 1]
    seen: set[int] = set()
    for text, y in zip(texts, label.astype(int), strict=True):
        if (h := hash(text)) in seen:  # copies say nothing new
            continue
        seen.add(h)
        per: dict[str, int] = {}
        for w in _WORD.findall(text):
            per[w] = per.get(w, 0) + 1
        words[y] += sum(per.values())
        own: dict[str, int] = {}
        for w, n in per.items():
            for k in range(stem_lengths[0], min(len(w), stem_lengths[1]) + 1):
                own[w[:k]] = own.get(w[:k], 0) + min(n, 20)
        for s, n in own.items():
            counts[y][s] = counts[y].get(s, 0) + n
            if y:
                docs[s] = docs.get(s, 0) + 1
    min_docs = min_docs or int(max(3, min(12, label.sum() // 12)))
    scored = []
    for s, d in docs.items():
        if d < min_docs:
            continue
        a, b = counts[1][s], counts[0].get(s, 0)
        expected = (a + b) * words[1] / (words[0] + words[1])
        gain = np.log((a + 0.5) / words[1]) - np.log((b + 0.5) / words[0])
        if gain > 1.0 and a > 2.5 * expected + 10:
            scored.append((a * gain, s, float(min(gain, 6.0))))
    weights = {w: 3.0 for w in SEEDS}
    chosen: list[str] = []
    for _, s, gain in sorted(scored, key=lambda x: (-x[0], -len(x[1]), x[1]))[: 20 * max_stems]:
        if len(chosen) < max_stems and not any(s.startswith(c) or c.startswith(s) for c in chosen):
            chosen.append(s)
            weights[s] = gain
    found = Lexicon(weights)
    automaton = found.automaton()
    x = np.array([features(t, automaton) for t in texts])
    found.coefficients = tuple(logistic(x, label))
    return found


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Newton's method; small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learning_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, max_chars: int = 12_000_000, max_length: int = 20_000, folds: int = 5) -> tuple[list[str], list[int]]:
    """A bounded sample (max_rows rows, max_chars characters in all, max_length in one) of labelled texts outside the held-out part, by hash of the id; whole texts only."""
    mine, tagged = pick(docs, id="doc_id", text="text"), pick(labels, id="doc_id", toxic="toxic")
    tagged = tagged.where(F.col("toxic").isNotNull() & F.col("id").isNotNull() & (crc_fold(F.col("id"), folds) != 0)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    first = tagged.orderBy(F.xxhash64("id"), "id").limit(max_rows)  # at most max_rows small rows
    rows = mine.where(F.length("text") <= max_length).join(F.broadcast(first), "id")
    # sizes come first, so that no more than max_chars characters of text ever reach the driver
    facts = rows.groupBy("id").agg(F.sum(F.length("text")).alias("chars")).collect()  # at most max_rows small rows
    order = lambda i: (zlib.crc32(f"{i} sample".encode()), i)
    kept, total = [], 0
    for r in sorted(facts, key=lambda r: order(r["id"])):
        total += r["chars"]
        if total > max_chars:
            break
        kept.append(r["id"])
    texts, toxic = [], []
    for r in sorted(rows.where(F.col("id").isin(kept)).collect(), key=lambda r: (order(r["id"]), r["text"]))[:max_rows]:
        texts.append(r["text"])
        toxic.append(int(r["toxic"]))
    return texts, toxic


def scores(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_hits for every row; a map without any shuffle."""
    w = np.array(lexicon.coefficients)

    def run(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            got = np.array([features(t.as_py(), automaton) for t in batch.column(1)]).reshape(-1, 4)
            score = 1 / (1 + np.exp(-np.clip(got @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(score), pa.array(np.rint(np.expm1(got[:, 2])).astype(np.int32))], ["doc_id", "score", "n_hits"])

    return pick(docs, id=id_col, text=text_col).mapInArrow(run, "doc_id long, score double, n_hits int")


def op3(spark, sf_dir) -> DataFrame:
    from strataloom.llm.common import table

    docs = table(spark, sf_dir, "documents")
    lexicon = learn(*learning_rows(docs, table(spark, sf_dir, "labels")))
    return scores(docs, lexicon).select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score 0.5 or more; all columns stay as they are."""
    lexicon = learn(*learning_rows(docs, labels))
    w = np.array(lexicon.coefficients)

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        automaton = lexicon.automaton()
        return pd.Series([float(np.dot(features(t, automaton), w)) >= 0 for t in texts], dtype=bool)

    return docs.where(~toxic(docs["text"]))
