"""Language identification (op 7): nearest centroid over normalised TF-IDF character n-grams, with rejection.

A text is a vector of hashed 1- to 3-grams of its letters (word boundaries count as one blank), weighted
log(1 + tf) * idf and normalised. Each language has several centroids from spherical k-means; the nearest by cosine
names the language. A text is rejected if its cosine is far below that of held-out training texts of about its size
or not clearly above what hash collisions give a text in unknown letters of that size, or if it has no letter.

Learning reads only training rows, in at most ``LANGUAGES`` languages, and all of them: document frequencies, centroids
and the quantiles of cosines for rejection. K-means starts in one task for each language, on a sample of about ``SAMPLE``
rows at most, chosen by a hash of the text (rows with equal n-gram counts and language are one row of it, so copies can't
swell it). Its centroids only say where the whole begins: each becomes the mean of all training rows nearest to it, summed
in integers by tasks. The cosines of all rows with centroids of the other half of the rows are counted in ``BINS`` bins.

Defined results: null, empty and letterless texts are ``und``, score 0, rejected; with no training rows every text
is; repeated rows give repeated results; an empty table gives an empty table; texts of any length are read whole; ties go
to the first language by name; other columns are kept where asked, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.llm import vec
from lodestrata.llm.common import fields, quoted, stored, text_map

DIM, SAMPLE, CENTROIDS, ROUNDS = 4096, 6000, 4, 12
#: Languages learned at most, those of most rows: more than have a two-letter code, so only junk labels go beyond it.
LANGUAGES = 512
#: Bins of a cosine.
BINS = 10_000
#: A text is rejected below this share of the 5 % quantile of held-out training cosines in its size class (some per cent
#: of training rows can be junk), and below this multiple of the cosine of texts of random letters.
REJECT, COLLISION = 0.35, 1.15


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x DIM counts of hashed n-grams, letters by text)."""
    kind, lower, _, _ = vec.tables()
    cp, starts = vec.codes(texts)
    at = np.minimum(cp, vec._TOP - 1)
    letter = kind[at] == vec.LETTER
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    letters = np.bincount(doc[letter], minlength=len(texts))
    first = np.zeros(len(cp) + 1, bool)
    first[starts] = True
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # the character before a word stands for its boundary
    keep[1:] |= letter[:-1]
    return grams(np.where(letter, lower[at], 32).astype(np.uint64)[keep], doc[keep], len(texts)), letters


def grams(c: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """texts x DIM counts of hashed n-grams of characters c of the texts doc."""
    n = len(c)
    h = c + np.uint64(1)
    idx = []
    for size in (1, 2, 3):
        if size > 1:
            h = h[:-1] * np.uint64(0x100000001B3) + c[size - 1 :] + np.uint64(1) if n >= size else h[:0]
        same = doc[: len(h)] == doc[size - 1 : size - 1 + len(h)] if len(h) else np.zeros(0, bool)
        slot = (vec.mix(h) >> np.uint64(64 - 12)).astype(np.int64)
        idx.append((doc[: len(h)] * DIM + slot)[same])
    flat = np.bincount(np.concatenate(idx), minlength=texts * DIM)
    return flat.reshape(texts, DIM)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def size_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), 15)


@dataclass
class Model:
    """langs: language of each centroid; floor: cosine by size class below which a text is rejected."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    floor: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        tf, letters = counts(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        x = unit(np.log1p(tf).astype(np.float32) * self.idf)
        sims = x @ self.centroids.T
        best = sims.argmax(axis=1)
        top = np.where(letters > 0, np.clip(sims[np.arange(len(texts)), best], 0, 1), 0.0)
        rejected = (letters == 0) | (top < self.floor[size_class(letters)])
        names = [self.langs[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, top.astype(float), rejected


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows; the start is farthest-first from the mean."""
    c = unit(x.mean(axis=0, keepdims=True))
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[(x @ c.T).max(axis=1).argmin()]])
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = unit(np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


def collisions(idf: np.ndarray, centroids: np.ndarray, draws: int = 128) -> np.ndarray:
    """Cosine, by size class, of texts of random letters: in alphabets that no text has (only hashes and blanks can
    agree), and a to z.

    The 98 % quantile of the draws of the alphabet where it is largest, at least that of smaller size classes. Clean texts
    of few letters lie as low and are to stay: the quantile is 90 % below 64 letters and the median below 32.
    """
    rng = np.random.Generator(np.random.PCG64(7))
    top = np.zeros(16)
    for size in range(16):
        letters = 2 ** (size + 1) - 1 if size < 15 else 2**18  # the last class has no upper end
        for alphabet in (24, 32, 2000, 26):
            found = []
            for _ in range(draws if size < 8 else draws // 4 if size < 10 else 1):  # long texts hardly differ
                base = 97 if alphabet == 26 else 0x110000 + int(rng.integers(1 << 40))  # behind the last character
                c = rng.integers(base, base + alphabet, letters).astype(np.uint64)
                ends = np.cumsum(rng.integers(2, 9, letters // 2 + 1))
                c = np.concatenate([[np.uint64(32)], np.insert(c, ends[ends < letters], 32), [np.uint64(32)]])
                x = unit(np.log1p(grams(c, np.zeros(len(c), np.int64), 1)).astype(np.float32) * idf)
                found.append(float((x @ centroids.T).max()))
            top[size] = max(top[size], float(np.quantile(found, 0.98 if size > 5 else 0.9 if size == 5 else 0.5)))
    return np.maximum.accumulate(top)


def floors_of(held: np.ndarray, collide: np.ndarray) -> np.ndarray:
    """Cosine by size class below which a text is rejected, from counts of held-out training cosines (size classes x
    BINS + 1) and cosines of collisions."""
    n = held.sum(axis=1)
    low = (np.cumsum(held, axis=1) > 0.05 * (n[:, None] - 1)).argmax(axis=1) / BINS
    known = [(i, REJECT * float(low[i])) for i in range(16) if n[i] >= 20]
    # a size class with few training texts takes the share of the nearest smaller one; collisions bound every class
    share = [max((k for k in known if k[0] <= i), default=(0, 0.0))[1] for i in range(16)]
    return np.maximum(share, COLLISION * collide)


def vector_keys(tf: np.ndarray) -> tuple[list[bytes], list[int]]:
    """Counts of each text as bytes and a hash of them; its last bit deals equal texts to the same half."""
    rows = [row.tobytes() for row in np.log1p(tf).astype(np.float16)]
    return rows, [int.from_bytes(hashlib.blake2b(row, digest_size=8).digest(), "little", signed=True) for row in rows]


def of_languages(rows: DataFrame, idf: np.ndarray, schema: str, make):
    """``make()`` gives kernel(lang, unit vectors, halves, size classes), called by step and language, and finish()."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def inner():
        each, finish = make()

        def kernel(texts, kept):
            tf, letters = counts(texts)
            half = np.array(vector_keys(tf)[1], np.int64) & 1
            x = unit(np.log1p(tf).astype(np.float32) * shared.value)
            lang = np.array([k if n else "" for k, n in zip(kept["lang"], letters.tolist(), strict=True)], object)
            for name in sorted(set(lang[letters > 0])):
                own = np.flatnonzero((lang == name) & (letters > 0))
                each(name, x[own], half[own], size_class(letters[own]))

        kernel.finish = finish
        return kernel

    return text_map(rows, schema, inner, "text", ("lang",))


def whole_centroids(rows: DataFrame, idf: np.ndarray, starts: dict[str, list[np.ndarray]]) -> dict[str, list[np.ndarray]]:
    """For each language three sets of centroids, of all rows and of each half: the means of the rows nearest to those of
    ``starts``, which stay where no row is nearest. Sums are of integers, so no order of rows changes them."""
    shared = rows.sparkSession.sparkContext.broadcast(starts)

    def make():
        sums: dict[tuple, np.ndarray] = {}

        def each(name, x, half, sizes):
            for which, c in enumerate(shared.value.get(name, [])):
                own = np.flatnonzero(half == which - 1) if which else np.arange(len(x))
                if not len(c) or not len(own):
                    continue
                near = (x[own] @ c.T).argmax(axis=1)
                whole = np.rint(x[own] * np.float32(1 << 24)).astype(np.int64)
                for k in np.unique(near).tolist():
                    sums[name, which, k] = sums.get((name, which, k), 0) + whole[near == k].sum(axis=0)

        def finish():
            keys = sorted(sums)
            return {"lang": [k[0] for k in keys], "which": [k[1] for k in keys], "k": [k[2] for k in keys], "y": [sums[k].tobytes() for k in keys]}

        return each, finish

    def total(batches):
        sums: dict[tuple, np.ndarray] = {}
        names = ["lang", "which", "k", "y"]
        for batch in batches:
            for *key, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[tuple(key)] = sums.get(tuple(key), 0) + np.frombuffer(y, np.int64)
        for key, y in sums.items():
            unit_row = unit(y[None, :].astype(float)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()), pa.array([unit_row.tobytes()], pa.binary())], names=names)

    schema = "lang string, which int, k int, y binary"
    found = of_languages(rows, idf, schema, make).repartition("lang", "which", "k").mapInArrow(total, schema)
    out = {name: [c.copy() for c in sets] for name, sets in starts.items()}
    for r in found.collect():  # as many rows as there are centroids
        out[r["lang"]][r["which"]][r["k"]] = np.frombuffer(r["y"], np.float32)
    return out


def held_cosines(rows: DataFrame, idf: np.ndarray, learned: dict[str, list[np.ndarray]]) -> np.ndarray:
    """Counts (size classes x BINS + 1) of the best cosine of every row with its language's centroids of the other half."""
    shared = rows.sparkSession.sparkContext.broadcast(learned)

    def make():
        tally = np.zeros(16 * (BINS + 1), np.int64)

        def each(name, x, half, sizes):
            sets = shared.value.get(name, [])
            for h in (0, 1) if sets else ():
                own, c = np.flatnonzero(half == h), sets[2 - h]
                if len(c) and len(own):
                    best = np.clip((x[own] @ c.T).max(axis=1), 0, 1)
                    tally[:] += np.bincount(sizes[own] * (BINS + 1) + (best * BINS).astype(np.int64), minlength=len(tally))

        def finish():
            at = np.flatnonzero(tally)
            return {"slot": at, "n": tally[at]}

        return each, finish

    found = of_languages(rows, idf, "slot int, n bigint", make).groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # a table of fixed size
    tally = np.zeros(16 * (BINS + 1), np.int64)
    tally[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return tally.reshape(16, BINS + 1)


def fit(df: DataFrame, train: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS, languages: int = LANGUAGES) -> Model:
    """Learn from the rows of ``df`` where ``train`` holds and text and language are not null."""
    rows = df.where(train & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    total = sum(sizes.values())
    if not total:
        return Model(np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), [], np.zeros(16))
    share = max(1, sample // len(sizes))
    cut = F.lit(0.0)
    for name, n in sizes.items():
        cut = F.when(F.col("lang") == name, F.lit(min(1.0, share / n))).otherwise(cut)
    chosen = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < cut * 1_000_003
    rows = rows.withColumn("chosen", F.coalesce(chosen, F.lit(False)))

    def make():
        df_sum, sent = np.zeros(DIM, np.int64), set()

        def kernel(texts, kept):
            nonlocal df_sum
            tf, letters = counts(texts)
            df_sum += (tf > 0).sum(axis=0)
            own, keys, rows = [], [], []
            sampled = [i for i, c in enumerate(kept["chosen"]) if c and letters[i]]
            for i, row, key in zip(sampled, *vector_keys(tf[sampled]), strict=True):
                if (kept["lang"][i], key) not in sent:  # as many as the sample has vectors
                    sent.add((kept["lang"][i], key))
                    own.append(i)
                    keys.append(key)
                    rows.append(row)
            return {"lang": [kept["lang"][i] for i in own], "letters": letters[own], "slot": [None] * len(own), "n": keys, "tf": rows}

        def finish():
            slots = np.flatnonzero(df_sum)
            return {"lang": [None] * len(slots), "letters": [None] * len(slots), "slot": slots, "n": df_sum[slots], "tf": [None] * len(slots)}

        kernel.finish = finish
        return kernel

    out = stored(text_map(rows, "lang string, letters bigint, slot int, n bigint, tf binary", make, "text", ("lang", "chosen")), "langid-fit")
    freq = np.zeros(DIM)
    for r in out.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        freq[r["slot"]] = r["n"]
    idf = (np.log((1 + total) / (1 + freq)) + 0.1).astype(np.float32)
    shared = df.sparkSession.sparkContext.broadcast(idf)

    def learn(table: pa.Table) -> pa.Table:
        """Centroids of one language: of all its rows of the sample and of each half."""
        order = sorted(zip(table.column("tf").to_pylist(), table.column("n").to_pylist(), strict=True))
        x = np.stack([np.frombuffer(t, np.float16) for t, _ in order]).astype(np.float32)
        x *= shared.value
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-12))
        half = np.array([n & 1 for _, n in order])
        sets = [spherical_kmeans(v, centroids).astype(np.float32) if len(v) else v for v in (x, x[half == 0], x[half == 1])]
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()], pa.string()), "sets": pa.array([[c.tobytes() for c in sets]], pa.list_(pa.binary()))})

    vectors_by = out.where("tf is not null").dropDuplicates(["lang", "n"]).select("lang", "n", "tf")
    begun = vectors_by.groupBy("lang").applyInArrow(learn, "lang string, sets array<binary>").collect()  # one row by language
    starts = {r["lang"]: [np.frombuffer(c, np.float32).reshape(-1, DIM) for c in r["sets"]] for r in begun}
    if not starts:
        return Model(idf, np.zeros((0, DIM), np.float32), [], np.zeros(16))
    learned = whole_centroids(rows, idf, starts)
    names = [k for k in sorted(learned) for _ in learned[k][0]]
    vectors = np.vstack([learned[k][0] for k in sorted(learned)])
    return Model(idf, vectors, names, floors_of(held_cosines(rows, idf, learned), collisions(idf, vectors)))


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The kept columns, lang_pred, score and rejected for every row; ``prefix`` goes before these three names, so that
    kept columns may have them."""
    names = [prefix + n for n in ("lang_pred", "score", "rejected")]
    schema = fields(df, keep, ", ".join(f"{quoted(n)} {k}" for n, k in zip(names, ("string", "double", "boolean"), strict=True)))
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded: languages x centroids x DIM

    def make():
        def kernel(texts, kept):
            return {**kept, **dict(zip(names, shared.value.predict(texts), strict=True))}

        return kernel

    return text_map(df, schema, make, text, keep)
