"""Language ID in two steps: the language family first, then one-versus-one linear SVMs between languages of that family.

Features are hashed byte 1- to 3-grams of the lower-cased letters of the whole text, as relative frequencies, so a linear
score is the mean weight over the text's n-grams and needs one table look-up per n-gram. Families are told apart by
one-versus-one SVMs too; the votes of each step pick the winner (ties: larger summed margin, then the smaller name).

Defined cases: null texts and texts without a letter get `und` and score 0; a null id is held out from learning; rows
with a null lang are never learned from; with one learned language every text with a letter gets it; with none, `und`.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import crc_fold, pick, table, utf8_parts

# Family of each language code; codes that aren't here form a family of their own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "semitic": ["ar", "he", "am", "mt"],
    "uralic": ["fi", "et", "hu"],
    "indo-aryan": ["hi", "bn", "ur", "mr", "pa", "gu", "ne"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
BITS = 13


def family(lang: str) -> str:
    return FAMILY_OF.get(lang, f"only {lang}")


def gram_ids(data: np.ndarray, begins: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of the 1-, 2- and 3-grams that end at each byte; begins: where texts start, whose grams reach no further back."""
    b = data.astype(np.uint32)
    two = b.copy()
    two[1:] += b[:-1] * np.uint32(257)
    two[begins] = b[begins]
    three = two.copy()
    three[2:] += b[:-2] * np.uint32(66049)
    for at in (begins, np.minimum(np.asarray(begins) + 1, len(b) - 1)):
        three[at] = two[at]
    mix = lambda x, salt: ((x * np.uint32(2654435761) + np.uint32(salt)) >> np.uint32(32 - BITS)).astype(np.int32)
    return mix(b, 97), mix(two, 1_000_003), mix(three, 777_767_777)


def _plain() -> np.ndarray:
    """Byte -> itself for letters (ASCII lower-cased, all of UTF-8's upper half), else a space."""
    to = np.full(256, 32, np.uint8)
    for c in range(ord("a"), ord("z") + 1):
        to[c] = to[c - 32] = c
    to[128:] = np.arange(128, 256)
    return to


PLAIN = _plain()


@dataclass
class Pair:
    a: str
    b: str
    weights: np.ndarray  # of the margin: positive for a
    bias: float


@dataclass
class Model:
    """families: pairs of families; within: pairs of languages for each family; langs: the learned values by family."""

    langs: dict[str, list[str]]
    families: list[Pair]
    within: dict[str, list[Pair]]


def histogram(text: str) -> np.ndarray:
    """Relative frequencies of a text's hashed n-grams."""
    data = PLAIN[utf8_parts(pc.utf8_lower(pa.array([text])))[0]]  # as in predict_batch
    ids = np.concatenate(gram_ids(data)) if len(data) else np.zeros(0, np.int64)
    return np.bincount(ids, minlength=1 << BITS).astype(np.float32) / max(1, len(ids))


def svm(x: np.ndarray, sign: np.ndarray, c: float = 10.0, epochs: int = 25, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; rows are scaled to unit length by the caller."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha, q = np.zeros(x.shape[1]), np.zeros(len(x)), np.einsum("ij,ij->i", x, x).astype(float)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] - (sign[i] * (x[i] @ w) - 1) / q[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * sign[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w[:-1], float(w[-1])


def learn(texts: list[str], langs: list[str], per_class: int = 300) -> Model:
    """Families and languages from up to per_class texts of each language (the caller bounds the sample)."""
    by: dict[str, list[str]] = {}
    for t, lang in zip(texts, langs, strict=True):
        if len(by.setdefault(lang, [])) < per_class:
            by[lang].append(t)
    known: dict[str, list[str]] = {}
    for lang in sorted(by):
        known.setdefault(family(lang), []).append(lang)
    rows = {lang: np.array([histogram(t) for t in own]) for lang, own in by.items()}
    # square roots tame frequent n-grams in learning only through the scale of each column
    scale = (1 / (np.mean([own.mean(0) for own in rows.values()], 0) ** 0.5 + 1e-3)).astype(np.float32) if rows else np.ones(1, np.float32)

    def pair(a: str, b: str, of_a: list[str], of_b: list[str]) -> Pair:
        x = np.concatenate([rows[lang] for lang in (*of_a, *of_b)]) * scale
        sign = np.repeat([1.0, -1.0], [sum(len(rows[k]) for k in of_a), sum(len(rows[k]) for k in of_b)])
        norm = float(np.sqrt(np.einsum("ij,ij->i", x, x)).mean()) or 1.0
        x /= np.float32(norm)
        w, bias = svm(x, sign)
        return Pair(a, b, (w * scale / norm).astype(np.float32), bias)

    pairs = [pair(a, b, known[a], known[b]) for a, b in itertools.combinations(sorted(known), 2)]
    return Model(known, pairs, {f: [pair(a, b, [a], [b]) for a, b in itertools.combinations(own, 2)] for f, own in known.items()})


def learning_rows(docs: DataFrame, per_lang: int = 300, max_chars: int = 4000, max_langs: int = 2000, folds: int = 3, held_out: int = 1) -> tuple[list[str], list[str]]:
    """For each language the texts of the per_lang rows (not held out) that come first by hash of the id.

    Texts of at most max_chars characters come first; a language with fewer than per_lang of them is filled up with its longer
    texts, as long as those of a language add up to per_lang * max_chars characters at most (one of any length is taken).
    More than max_langs languages: those with the most rows.
    """
    mine = pick(docs, id="doc_id", text="text", lang="lang").where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    mine = mine.where(crc_fold(F.col("id"), folds) != held_out).select("id", "lang", F.length("text").alias("chars"), F.xxhash64("id").alias("h"))
    short = (F.col("chars") <= max_chars).cast("long")
    counted = mine.groupBy("lang").agg(F.count("*").alias("n"), F.sum(short).alias("short")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()  # one row a language
    if not counted:
        return [], []

    def some(rows: DataFrame, counts: dict[str, int], want: int) -> list:
        """About the first rows of each language by hash: a share that holds about twice the wanted rows, so no language's rows meet in one task."""
        share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, 2.0 * want / n + 50.0 / n))) for k, n in counts.items()))
        return rows.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).orderBy("h", "id").limit(len(counts) * (2 * want + 200)).collect()  # small rows

    first = [r for r in some(mine.where(F.col("chars") <= max_chars), {r["lang"]: r["short"] for r in counted if r["short"]}, per_lang)] if any(r["short"] for r in counted) else []
    few = {r["lang"]: r["n"] - r["short"] for r in counted if r["short"] < per_lang and r["n"] > r["short"]}
    longer = some(mine.where((F.col("chars") > max_chars) & F.col("lang").isin(list(few))), few, per_lang) if few else []
    left = {r["lang"]: [per_lang, per_lang * max_chars] for r in counted}
    wanted = []
    for r in [*sorted(first, key=lambda r: (r["h"], r["id"])), *sorted(longer, key=lambda r: (r["chars"], r["h"], r["id"]))]:
        room = left.get(r["lang"])
        if room and room[0] > 0 and (r["chars"] <= room[1] or room[0] == per_lang):
            room[0] -= 1
            room[1] -= r["chars"]
            wanted.append((r["id"], r["lang"], r["h"], r["chars"]))
    chosen = docs.sparkSession.createDataFrame(wanted, "id long, lang string, h long, chars int").distinct()
    rows = pick(docs, id="doc_id", text="text", lang="lang").withColumn("chars", F.length("text")).join(F.broadcast(chosen), ["id", "lang", "chars"]).collect()
    rows = sorted(rows, key=lambda r: (r["h"], r["id"], r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def predict_batch(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Languages and scores of a batch of texts."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    has = pc.match_substring_regex(lower, r"\p{L}").to_numpy(zero_copy_only=False)
    data, at = utf8_parts(lower)
    n = len(at) - 1
    data, length = PLAIN[data], np.diff(at)
    pairs = [*model.families, *(p for own in model.within.values() for p in own)]
    margins = np.zeros((len(pairs), n))
    if pairs and len(data):
        w = np.stack([p.weights for p in pairs], 1)
        sums = np.zeros((n, len(pairs)))
        step, begins = 1 << 18, at[:-1][length > 0]
        docs = np.repeat(np.arange(n), length) if len(data) < 1 << 22 else None
        for lo in range(0, len(data), step):  # a slice at a time; three bytes of context before it
            hi, back = min(lo + step, len(data)), max(0, lo - 2)
            ids = gram_ids(data[back:hi], begins[np.searchsorted(begins, back) : np.searchsorted(begins, hi)] - back)
            own = docs[lo:hi] if docs is not None else np.searchsorted(at, np.arange(lo, hi), "right") - 1
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for k in range(len(pairs)):
                column = np.ascontiguousarray(w[:, k])
                one = column[ids[0][lo - back :]] + column[ids[1][lo - back :]] + column[ids[2][lo - back :]]
                sums[own[start], k] += np.add.reduceat(one, start, dtype=np.float64)
        margins = (sums / np.maximum(3 * length, 1)[:, None]).T + np.array([p.bias for p in pairs])[:, None]
    margin = {id(p): margins[i] for i, p in enumerate(pairs)}

    def vote(names: list[str], own: list[Pair]) -> tuple[np.ndarray, np.ndarray]:
        votes, total, least = np.zeros((len(names), n)), np.zeros((len(names), n)), np.full((len(names), n), np.inf)
        for p in own:
            m, a, b = margin[id(p)], names.index(p.a), names.index(p.b)
            votes[a] += m >= 0
            votes[b] += m < 0
            total[a] += m
            total[b] -= m
            least[a], least[b] = np.minimum(least[a], m), np.minimum(least[b], -m)
        best = np.lexsort((-np.arange(len(names))[:, None] + np.zeros((1, n)), total, votes), axis=0)[-1]
        return best, np.where(np.isinf(least[best, np.arange(n)]), 30.0, least[best, np.arange(n)])

    if not model.langs:
        return ["und"] * n, np.zeros(n)
    names = sorted(model.langs)
    chosen, sure = vote(names, model.families)
    out, score = np.full(n, "und", object), np.zeros(n)
    for k, name in enumerate(names):
        best, inner = vote(model.langs[name], model.within[name])
        mine = (chosen == k) & has
        out[mine] = np.array(model.langs[name], object)[best[mine]]
        score[mine] = 1 / (1 + np.exp(-np.clip(3 * np.minimum(sure, inner)[mine], -30, 30)))
    return list(out), score


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row; a map without any shuffle."""

    def run(batches):
        for batch in batches:
            lang, score = predict_batch(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return pick(docs, id=id_col, text=text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(*learning_rows(docs))
    return predict(docs, model).select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
