"""Benchmark decontamination (op 8): latent semantic retrieval, then common subsequences and answer checks.

Passages are vectors of hashed words, tf * idf, with document frequencies over all passages of the corpus. A randomised
SVD (range finder with power iterations) of the matrix of all distinct passages, from its Gram matrix, which tasks sum
over every passage, gives a latent space, whitened; a passage counts once, so that copies don't take the directions. Every window of 32 words of every text (16 apart) is
projected and compared by cosine with the items; all windows are searched and no number of candidates is capped. Each
candidate region is then aligned with its item by the longest common subsequence of words.

A text holds an item if the subsequence covers ``COPY`` of the item's words, or, as a paraphrase, ``PARAPHRASE`` of them
and the item's closing words (its answer) and enough of its rare words.

Defined results: null and empty texts and items match nothing; repeated rows give repeated results; a text that holds
several items has a row for each, and of an item's equally long subsequences in a text the first counts; texts of any
length are searched whole; other columns are not read (``clean`` keeps them, whatever their names); empty tables give an
empty table; items go in blocks of ``ITEMS``, so what is broadcast is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from lodestrata.llm import vec
from lodestrata.llm.common import forget, stored, text_map

BITS, RANK, OVERSAMPLE, POWER = 12, 128, 16, 2
DIM = 1 << BITS
HALF = 16  # words of half a window
ITEMS = 20_000
#: Passages that a task sums to one part (DIM x DIM) of the Gram matrix, on average.
PART_PASSAGES = 1_000_000
#: Cosine from which a window is a candidate.
COSINE = 0.4
COPY, PARAPHRASE, ANSWER, RARE = 0.75, 0.6, 0.8, 0.6
#: Words at the end of an item that count as its answer.
ANSWER_WORDS = 8


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def halves(w: vec.Words) -> tuple[np.ndarray, np.ndarray]:
    """Words dealt to half windows: (first half of each text with one more at the end, half of each word)."""
    count = -(-w.counts // HALF)
    head = np.concatenate([[0], np.cumsum(count)])
    inside = np.arange(len(w.h)) - w.first[:-1][w.doc]
    return head, head[:-1][w.doc] + inside // HALF


def passages(w: vec.Words) -> np.ndarray:
    """Passage (whole, disjoint windows) of each word, numbered over all texts."""
    count = -(-w.counts // (2 * HALF))
    head = np.cumsum(count) - count
    return head[w.doc] + (np.arange(len(w.h)) - w.first[:-1][w.doc]) // (2 * HALF)


def surveyed(df: DataFrame, text: str) -> DataFrame:
    """One scan of the corpus: (slot, n), partial counts of the passages that hold each hashed word, with their number at
    slot DIM, and (slots), the word slots of every passage."""

    def make():
        freq = np.zeros(DIM + 1, np.int64)

        def kernel(texts, kept):
            w = vec.Words(texts)
            if not len(w.h):
                return None
            p, s = passages(w), slot(w.h)
            key = np.unique(p * DIM + s)
            freq[:-1] += np.bincount(key % DIM, minlength=DIM)
            freq[-1] += p[-1] + 1
            head = np.flatnonzero(np.append(True, p[1:] != p[:-1])) * 2  # in bytes
            flat = s.astype(np.int16).tobytes()
            rows = [flat[a:b] for a, b in zip(head.tolist(), [*head[1:].tolist(), len(flat)], strict=True)]
            return {"slot": [None] * len(rows), "n": [None] * len(rows), "slots": rows}

        def finish():
            at = np.flatnonzero(freq)
            return {"slot": at, "n": freq[at], "slots": [None] * len(at)}

        kernel.finish = finish
        return kernel

    return text_map(df, "slot int, n bigint, slots binary", make, text, ())


def add_products(g: np.ndarray, diagonal: np.ndarray, rows: list[bytes], idf: np.ndarray) -> None:
    """Add x x' of passages, tf * idf in unit rows, to ``g`` (products of a word with later ones) and ``diagonal``."""
    words = np.array([len(r) // 2 for r in rows])
    places = np.full((len(rows), 2 * HALF), DIM)
    places[np.arange(2 * HALF) < words[:, None]] = np.frombuffer(b"".join(rows), np.int16)
    places = np.ascontiguousarray(places.T)
    w = np.append(idf, 0).astype(float)[places]
    square = (w * w).sum(axis=0)
    for k in range(1, 2 * HALF):  # words k places apart; equal ones make one entry of x
        square += 2 * (w[k:] * w[:-k] * (places[k:] == places[:-k])).sum(axis=0)
    w /= np.sqrt(np.maximum(square, 1e-18))
    at, flat = places * (DIM + 1), g.reshape(-1)
    for k in range(1, 2 * HALF):
        np.add.at(flat, (at[:-k] + places[k:]).reshape(-1), (w[:-k] * w[k:]).reshape(-1))
    diagonal += np.bincount(places.reshape(-1), (w * w).reshape(-1), DIM + 1)


def gram(table: DataFrame, idf: np.ndarray) -> DataFrame:
    """(row, y): the rows of A'A over all stored passages, as 32-bit floats, stored.

    Each task sums about ``PART_PASSAGES`` passages, so what is shuffled is a part of what was read; a task of the sum
    holds its rows only.
    """
    shared = table.sparkSession.sparkContext.broadcast(idf)
    parts = max(1, -(-table.count() // PART_PASSAGES))

    def rows_of(numbers, values):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in values], pa.binary())], names=["row", "y"])

    def run(batches):
        g, diagonal = np.zeros((DIM + 1, DIM + 1)), np.zeros(DIM + 1)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for lo in range(0, len(rows), 512):
                add_products(g, diagonal, rows[lo : lo + 512], shared.value)
        for lo in range(0, DIM if diagonal.any() else 0, 256):
            y = g[lo : lo + 256, :DIM] + g[:DIM, lo : lo + 256].T
            y[np.arange(256), np.arange(lo, lo + 256)] += diagonal[lo : lo + 256]
            held = np.flatnonzero(y.any(axis=1))
            yield rows_of(held + lo, y[held])

    def total(batches):
        sums = {}
        for batch in batches:
            for row, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[row] = sums.get(row, 0) + np.frombuffer(y, np.float32).astype(float)
        numbers = sorted(sums)
        for lo in range(0, len(numbers), 256):
            yield rows_of(numbers[lo : lo + 256], [sums[k] for k in numbers[lo : lo + 256]])

    schema = "row int, y binary"
    return stored(table.coalesce(parts).mapInArrow(run, schema).repartition("row").mapInArrow(total, schema), "gram")


def gram_times(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """A'A q from the stored rows of A'A; the driver gets a matrix as large as q."""
    shared = rows.sparkSession.sparkContext.broadcast(q.astype(np.float32))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            y = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, DIM) @ shared.value
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.astype(float).tobytes() for v in y], pa.binary())], names=["row", "y"])

    found = rows.mapInArrow(run, "row int, y binary").toArrow()  # DIM rows at most
    out = np.zeros(q.shape)
    for row, y in zip(*(c.to_pylist() for c in found.columns), strict=True):
        out[row] = np.frombuffer(y)
    shared.unpersist()
    return out


def latent_space(table: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """DIM x rank projection onto whitened right singular vectors (randomised, seeded)."""
    rng = np.random.Generator(np.random.PCG64(8))
    rows = gram(table, idf)
    q = rng.standard_normal((DIM, rank + OVERSAMPLE))
    for _ in range(POWER):
        q, _ = np.linalg.qr(gram_times(rows, q))
    values, vectors = np.linalg.eigh(q.T @ gram_times(rows, q))
    forget(rows)
    top = np.argsort(values)[::-1][:rank]
    values = values[top]
    kept = values > 1e-8 * max(values.max(initial=0), 1e-30)
    return (q @ vectors[:, top][:, kept] / np.sqrt(values[kept])).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def subsequence(item: list[int], region: list[int], least: int = 0) -> tuple[int, list[tuple[int, int]]]:
    """Length of the longest common subsequence, and (item place, region place) of one (bit-parallel, with a trace).

    Below ``least`` the length comes without a trace.
    """
    n = len(item)
    places: dict[int, int] = {}
    for i, x in enumerate(item):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << n) - 1
    v, states, kept = full, [full], []
    for j, x in enumerate(region):
        if x in places:  # other words leave the state as it is
            u = v & places[x]
            v = ((v + u) | (v - u)) & full
            states.append(v)
            kept.append(j)
    length = n - v.bit_count()
    if length < least:
        return length, []
    got, i = [], n
    for j in range(len(kept), 0, -1):
        if not i:
            break
        low = lambda state, k: k - (state & ((1 << k) - 1)).bit_count()  # noqa: E731  LCS of the first k item words
        while i and low(states[j], i) == low(states[j], i - 1):
            i -= 1
        if i and low(states[j - 1], i) < low(states[j], i):
            got.append((i - 1, kept[j - 1]))
            i -= 1
    return length, got[::-1]


def common_words(words: np.ndarray, counts: np.ndarray, region: np.ndarray) -> int:
    """Words that an item (sorted distinct words and how often each occurs) and a region share, repeats counted: no
    common subsequence is longer."""
    at = np.minimum(np.searchsorted(words, region), len(words) - 1)
    have = np.bincount(at[words[at] == region], minlength=len(words))
    return int(np.minimum(have, counts).sum())


@dataclass
class Items:
    """Benchmark items of one block: ids, word hashes, distinct ones with their counts, latent unit vectors."""

    ids: list
    words: list
    distinct: list
    vectors: np.ndarray


def items_of(rows: list, projection: np.ndarray, idf: np.ndarray) -> Items:
    rows = [(i, t) for i, t in rows if t]
    ids, words, vectors = [], [], []
    for lo in range(0, len(rows), 256):
        part = rows[lo : lo + 256]
        w = vec.Words([t for _, t in part])
        z = np.zeros((len(part), projection.shape[1]), np.float32)
        np.add.at(z, w.doc, projection[slot(w.h)] * idf[slot(w.h)][:, None])
        for k in np.flatnonzero(w.counts).tolist():
            ids.append(part[k][0])
            words.append(w.h[w.first[k] : w.first[k + 1]])
            vectors.append(z[k])
    return Items(ids, words, [np.unique(x, return_counts=True) for x in words], unit(np.array(vectors, np.float32).reshape(len(ids), projection.shape[1])))


def search(texts: list[str], items: Items, projection: np.ndarray, idf: np.ndarray, cosine: float = COSINE) -> list[tuple]:
    """(text, item, cosine, subsequence share, answer share, start, end) of every item that a text holds."""
    w = vec.Words(texts)
    if not len(w.h) or not items.ids:
        return []
    head, half = halves(w)
    s = slot(w.h)
    weighted = projection * idf[:, None]
    # places of words in their half windows; a row of zeros stands for places without a word
    weighted = np.vstack([weighted, np.zeros((1, weighted.shape[1]), np.float32)])
    table = np.full((int(head[-1]) + 1, HALF), DIM, np.int64)
    inside = np.arange(len(s)) - w.first[:-1][w.doc]
    table[half, inside % HALF] = s
    z = np.zeros((len(table), weighted.shape[1]), np.float32)
    for lo in range(0, len(table), 1024):  # a step stays in the processor's cache
        part = z[lo : lo + 1024]
        for j in range(HALF):
            part += weighted[table[lo : lo + 1024, j]]
    doc = np.repeat(np.arange(len(texts)), np.diff(head))
    window = z[:-1].copy()
    next_same = np.append(doc[1:] == doc[:-1], False)
    window[next_same] += z[1:][next_same[: len(z) - 1]]
    window = unit(window)
    at, item, sims = [], [], []
    step = max(64, 4_000_000 // len(items.ids))
    for lo in range(0, len(window), step):
        part = window[lo : lo + step] @ items.vectors.T
        a, i = np.nonzero(part >= cosine)
        at.append(a + lo)
        item.append(i)
        sims.append(part[a, i])
    at, item, sims = (np.concatenate(x) for x in (at, item, sims))
    order = np.lexsort((at, item, doc[at]))
    out, groups, near = [], {}, {}
    for k in order.tolist():
        key = int(doc[at[k]]), int(item[k])
        groups.setdefault(key, []).append(int(at[k]))
        near[key] = max(near.get(key, -1.0), float(sims[k]))
    for (d, i), windows in groups.items():
        words = items.words[i]
        n, base, size = len(words), int(w.first[d]), int(w.counts[d])
        best, regions = None, []
        for a in windows:
            lo = (a - int(head[d])) * HALF - n
            hi = lo + 2 * HALF + 2 * n
            if regions and lo <= regions[-1][1] and regions[-1][1] - regions[-1][0] < 4 * n + 4 * HALF:
                regions[-1][1] = hi
            else:
                regions.append([lo, hi])
        own, times = items.distinct[i]
        least = int(np.ceil(PARAPHRASE * n - 1e-9))
        for lo, hi in regions:
            lo, hi = max(0, lo), min(size, hi)
            region = w.h[base + lo : base + hi]
            if common_words(own, times, region) < least:
                continue
            length, pairs = subsequence(words.tolist(), region.tolist(), least)
            if length >= least and (best is None or length > best[0]):
                best = (length, pairs, lo)
        if best is None:
            continue
        length, pairs, lo = best
        places = [x for x, _ in pairs]
        tail = range(max(0, n - ANSWER_WORDS), n)
        answer = len(set(places) & set(tail)) / len(tail)
        weight = idf[slot(words)]
        rare = float(weight[places].sum() / max(weight.sum(), 1e-9)) if places else 0.0
        share = length / n
        if share >= COPY or share >= PARAPHRASE and answer >= ANSWER and rare >= RARE:
            start, end = int(w.s[base + lo + pairs[0][1]] - w.starts[d]), int(w.e[base + lo + pairs[-1][1]] - w.starts[d])
            out.append((d, items.ids[i], near[d, i], round(share, 4), round(answer, 4), start, end))
    return out


@dataclass
class Model:
    projection: np.ndarray
    idf: np.ndarray


def fit(df: DataFrame, text: str = "text") -> Model:
    """Learn from one scan of all texts and all their passages."""
    found = stored(surveyed(df, text), "passages")
    freq = np.zeros(DIM + 1, np.int64)
    tally = found.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # DIM + 1 rows at most
    freq[tally.column("slot").to_numpy()] = tally.column("n").to_numpy()
    n = int(freq[-1])
    idf = np.log((n + 1) / (freq[:-1] + 1)).astype(np.float32)
    if not n:
        return Model(np.zeros((DIM, 1), np.float32), idf)
    table = stored(found.where("slots is not null").select("slots").distinct(), "distinct-passages")
    model = Model(latent_space(table, idf), idf)
    forget(found, table)
    return model


def item_blocks(benchmark: DataFrame, item_id: str, text: str):
    """Rows of the benchmark, in blocks of about ITEMS by a hash."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t is not null")
    blocks = -(-rows.count() // ITEMS)
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        yield sorted(((r["i"], r["t"]) for r in own), key=lambda x: (x[0] is None, x[0], x[1]))


def contaminated(df: DataFrame, benchmark: DataFrame, model: Model | None = None, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", cosine: float = COSINE) -> DataFrame:
    """One row for each text and item it holds: doc_id, item_id, cosine, lcs_share, answer_share, start, end."""
    model = model or fit(df, text)
    types = dict(df.dtypes)[doc_id], dict(benchmark.dtypes)[item_id]
    schema = f"doc_id {types[0]}, item_id {types[1]}, cosine double, lcs_share double, answer_share double, start bigint, end bigint"
    out = df.sparkSession.createDataFrame([], schema)
    for rows in item_blocks(benchmark, item_id, item_text):
        shared = df.sparkSession.sparkContext.broadcast((model, items_of(rows, model.projection, model.idf)))

        def make(shared=shared):
            m, items = shared.value

            def kernel(texts, kept):
                cols = list(zip(*search(texts, items, m.projection, m.idf, cosine), strict=True)) or [()] * 7
                return {"doc_id": [kept[doc_id][d] for d in cols[0]], **dict(zip(("item_id", "cosine", "lcs_share", "answer_share", "start", "end"), cols[1:], strict=True))}

            return kernel

        out = out.unionByName(text_map(df, schema, make, text, (doc_id,)))
    return out


def clean(df: DataFrame, benchmark: DataFrame, model: Model | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text", cosine: float = COSINE) -> DataFrame:
    """The rows of ``df``, all their columns, whose text holds no item; no shuffle of texts."""
    model = model or fit(df, text)
    names = tuple(df.columns)
    schema = StructType([StructField(f.name, f.dataType) for f in df.schema])
    for rows in item_blocks(benchmark, item_id, item_text):
        shared = df.sparkSession.sparkContext.broadcast((model, items_of(rows, model.projection, model.idf)))

        def make(shared=shared):
            m, items = shared.value

            def kernel(texts, kept):
                bad = {x[0] for x in search(texts, items, m.projection, m.idf, cosine)}
                good = [i for i in range(len(texts)) if i not in bad]
                return {c: [kept[c][i] for i in good] for c in names}

            return kernel

        df = text_map(df, schema, make, text, names)
    return df
