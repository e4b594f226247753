"""Near duplicates (op 10): improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

A text is the weighted set of its runs of five words, weight tf * idf, idf from document frequencies over the whole
corpus in a sketch of two hashed rows, less the noise that other shingles of a slot add. Frequencies count copies, too, so
idf is at least half of the greatest: what a large group of copies shares never weighs less than half of one copy's edits.
A changed word changes five runs: copies with 4 to 5 % of their words changed are at about ``THRESHOLD``, other texts of
the test tables below 0.3. Consistent weighted samples
(Ioffe's form, in logarithms, with the random variates of a shingle read from a fixed table) agree for two texts with
the probability of their weighted Jaccard similarity. Bands of samples make buckets; pairs of a bucket are compared by
their samples and, if those leave a chance, by the exact weighted Jaccard similarity of the texts. Links of THRESHOLD or
more make classes, by connected components.

A node is a word sequence, named by a 128-bit BLAKE2b digest, so exact copies are one node from the start and ids may be
null or repeated. In every bucket the least node is tested with all others, and classes are formed. Then, in a bucket of
up to SMALL nodes, all pairs of different classes are tested; in a larger one, the nodes outside the bucket's largest class
with all its nodes of other classes, block by block, by exact similarities from matrix products, which return links only.
Pairs within a class need no test and all others get one, so no link is left out, no task gathers a bucket, and the work
follows the nodes that a group's leader doesn't catch. Joins on a node, bucket or class that many rows share deal its rows
to parts.

Defined results: every input row gets one row (repeated rows alike); the class id is the least id of the class, null if
no row of it has one; texts without a word are alike only if equal; null texts count as empty; rows with null ids join
the class of their text, and texts that share an id are kept apart; texts of any length are read whole; other columns
are not read, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lodestrata.llm import vec
from lodestrata.llm.common import fields, forget, quoted, slices, spread_join, stored, text_map

WORDS, THRESHOLD = 5, 0.5
BANDS, ROWS = 24, 3
SAMPLES = BANDS * ROWS
#: Pairs that agree in fewer samples are not verified: at similarity 0.5 that has a chance of about 1e-5.
LEAST_AGREEMENT = 19
#: Least idf, as a share of the greatest.
LEAST_IDF = 0.5
#: Bits of each row of the sketch of document frequencies, and of the table of random variates.
FREQ_BITS, VARIATE_BITS = 16, 16
SMALL = 32
#: Nodes and characters of a block of a large bucket, on average.
BLOCK_NODES, BLOCK_CHARS = 256, 2_000_000


def weighted_sets(texts: list[str], size: int = WORDS, words: vec.Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, 52-bit shingle hash, tf) of every distinct shingle, by text, then hash."""
    h, doc = vec.grams(words or vec.Words(texts), size)
    if len(texts) > 4096:
        raise ValueError("too many texts in one step")
    key = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1), tf


def slots(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's slot in each of the sketch's two rows."""
    return (shingle >> np.uint64(52 - FREQ_BITS)).astype(np.int64), (vec.mix(shingle) >> np.uint64(64 - FREQ_BITS)).astype(np.int64)


def weight_of(shingle: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Idf by the row of the sketch that counts less."""
    a, b = slots(shingle)
    return np.maximum(idf[0][a], idf[1][b])


@lru_cache(1)
def variates() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r, 1/r, ln c and beta of the sampler: r, c ~ Gamma(2, 1), beta ~ U(0, 1)."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    n = 1 << VARIATE_BITS
    r, c, b = rng.gamma(2.0, 1.0, n), rng.gamma(2.0, 1.0, n), rng.random(n)
    return r.astype(np.float32), (1 / r).astype(np.float32), np.log(c).astype(np.float32), b.astype(np.float32)


@lru_cache(1)
def multipliers() -> list[int]:
    rng = np.random.Generator(np.random.PCG64(77))
    return [int(x) | 1 for x in rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)]


def samples(shingle: np.ndarray, weight: np.ndarray, head: np.ndarray) -> np.ndarray:
    """SAMPLES consistent weighted samples of each set; sets begin at ``head`` and are not empty."""
    r, inv, lnc, beta = variates()
    lnw = np.log(weight).astype(np.float32)
    out = np.empty((len(head), SAMPLES), np.uint32)
    for k, m in enumerate(multipliers()):
        mixed = shingle * np.uint64(m)
        at = (mixed >> np.uint64(64 - VARIATE_BITS)).astype(np.int64)
        rk, bk = r[at], beta[at]
        t = np.floor(lnw * inv[at] + bk)
        lna = lnc[at] - rk * (t - bk + np.float32(1))
        bits = lna.view(np.uint32)
        bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000))  # sorts as the number does
        ident = (mixed ^ (t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        key = (bits.astype(np.uint64) << np.uint64(32)) | (ident >> np.uint64(32))
        out[:, k] = np.minimum.reduceat(key, head).astype(np.uint32)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sample), BANDS), np.uint64)
    for b in range(BANDS):
        for j in range(ROWS):
            keys[:, b] = vec.mix(keys[:, b] * np.uint64(0x100000001B3) + sample[:, b * ROWS + j] + np.uint64(b + 1))
    return keys.view(np.int64)


def document_frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """The sketch (two rows) of document frequencies of shingles over all texts, and the number of texts."""
    size = 1 << FREQ_BITS

    def make():
        freq = np.zeros(2 * size + 1, np.int64)

        def kernel(texts, kept):
            _, shingle, _ = weighted_sets(texts)
            for k, s in enumerate(slots(shingle)):
                freq[k * size : (k + 1) * size] += np.bincount(s, minlength=size)
            freq[-1] += len(texts)

        def finish():
            at = np.flatnonzero(freq)
            return {"slot": at, "n": freq[at]}

        kernel.finish = finish
        return kernel

    freq = np.zeros(2 * size + 1, np.int64)
    tally = text_map(df, "slot int, n bigint", make, text, ()).groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # a table of fixed size
    freq[tally.column("slot").to_numpy()] = tally.column("n").to_numpy()
    return freq[:-1].reshape(2, size), int(freq[-1])


def inverse_frequencies(freq: np.ndarray, n: int) -> np.ndarray:
    """Idf by slot: a slot's count less what the other shingles of the table put there on average, and, so that chance
    alone makes no shingle rare, plus two of its standard deviations from one count up. At least ``LEAST_IDF`` of the
    greatest, so that copies, which count, too, don't take the weight from what they share."""
    noise = (freq.sum(axis=1, keepdims=True) - freq) / (freq.shape[1] - 1)
    own = np.clip(freq - noise, 0, n) + np.maximum(2 * np.sqrt(noise) - 1, 0)
    idf = np.maximum(np.log((n + 1) / (own + 1)), 0) + 0.2
    return np.maximum(idf, LEAST_IDF * idf.max()).astype(np.float32)


def signatures(df: DataFrame, idf: np.ndarray, text: str, doc_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept columns, node (digest of the word sequence), bands and samples; no bands for a text without a word."""
    shared = df.sparkSession.sparkContext.broadcast(idf)

    def make():
        weights = shared.value

        def kernel(texts, kept):
            w = vec.Words(texts)
            first = w.first.tolist()
            node = [vec.digest(w.h[a:b]) if a < b else vec.digest(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint8), person=b"no words") for a, b, t in zip(first[:-1], first[1:], texts, strict=True)]
            doc, shingle, tf = weighted_sets(texts, words=w)
            bands: list = [None] * len(texts)
            sketch: list = [None] * len(texts)
            if len(doc):
                head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                s = samples(shingle, tf * weight_of(shingle, weights), head)
                for i, k, row in zip(doc[head].tolist(), band_keys(s), s, strict=True):
                    bands[i], sketch[i] = k, row.tobytes()
            return {**kept, "__node": node, "__bands": bands, "__sketch": sketch}

        return kernel

    rows = keyed(df, text, doc_id, keep)
    names = tuple(c for c in rows.columns if c != "__t")
    schema = fields(rows, names, "__node binary, __bands array<bigint>, __sketch binary")
    found = text_map(rows, schema, make, "__t", names)
    return found.select(F.col("__id").alias("doc_id"), "__ra", "__rb", *[F.col(quoted(c)) for c in keep], F.col("__node").alias("node"), F.col("__bands").alias("bands"), F.col("__sketch").alias("sketch"))


def keyed(df: DataFrame, text: str, doc_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Id, text, kept columns and two hashes of id and text, by which rows are found again. All under reserved names."""
    own = F.col(quoted(doc_id)), F.col(quoted(text))
    return df.select(own[0].alias("__id"), own[1].alias("__t"), *[F.xxhash64(F.lit(k), *own).alias(n) for k, n in ((1, "__ra"), (2, "__rb"))], *[F.col(quoted(c)) for c in keep])


def candidate_texts(df: DataFrame, nodes: DataFrame, needed: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(node, text) of the needed nodes: the one shuffle of texts, at every size. One row of equal ones stays."""
    keys = needed.join(nodes.select("node", "__ra", "__rb"), "node")
    own = keyed(df, text, doc_id).drop("__id").join(keys.hint("merge"), ["__ra", "__rb"])
    return own.dropDuplicates(["__ra", "__rb"]).select("node", F.col("__t").alias("text"))


def apart(small: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of small buckets in different classes, but for those with the bucket's leader."""
    placed = small.join(labels, "node", "left").select("band", "node", "lead", F.coalesce("label", "node").alias("label"))
    open_ = placed.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("band")
    placed = stored(placed.join(open_, "band"), "open")
    left, right = (placed.where("node != lead").select("band", F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    return left.join(right, "band").where("a < b and la != lb").select("a", "b").distinct()


def agreeing(pairs: DataFrame, nodes: DataFrame, counts: DataFrame | None = None, least: int = LEAST_AGREEMENT) -> DataFrame:
    """Pairs (a, b) whose samples agree often enough. ``counts``: (a, n) of nodes that lead many pairs."""
    if counts is None:
        pairs = stored(pairs, "asked")
        counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    left, right = (nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
    both = spread_join(pairs, left, "a", "b", counts).join(right, "b").select("a", "b", "sa", "sb")
    schema = both.select("a", "b").schema

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, SAMPLES) for i in (2, 3))
                keep = np.flatnonzero((sa == sb).sum(axis=1) >= least)
                yield batch.select(["a", "b"]).take(keep)

    import pyarrow as pa

    def typed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])

    return both.mapInArrow(typed, schema)


def jaccards(first: list[str], second: list[str], idf: np.ndarray) -> np.ndarray:
    """Exact weighted Jaccard similarities of pairs of texts."""
    n = len(first)
    out = np.zeros(n)
    step = 512
    for lo in range(0, n, step):
        a, b = first[lo : lo + step], second[lo : lo + step]
        doc, shingle, tf = weighted_sets([*a, *b])
        w = tf * weight_of(shingle, idf).astype(float)
        pair, m = doc % len(a), len(a)
        total = np.bincount(pair, w, m)
        order = np.lexsort((shingle, pair))
        p, s, v = pair[order], shingle[order], w[order]
        same = np.flatnonzero((p[1:] == p[:-1]) & (s[1:] == s[:-1]))
        common = np.bincount(p[same], np.minimum(v[same], v[same + 1]), m)
        out[lo : lo + m] = np.where(total > 0, common / np.where(total > 0, total - common, 1), 0)
    return out


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Pairs (a, b) with an exact weighted Jaccard similarity of ``threshold`` or more."""
    left, right = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    both = spread_join(pairs, left, "a", "b", pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))).join(right, "b")
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def make():
        def kernel(texts, kept):
            keep = np.flatnonzero(jaccards(kept["ta"], texts, shared.value) >= threshold).tolist()
            return {x: [kept[x][i] for i in keep] for x in ("a", "b")}

        return kernel

    kind = dict(pairs.dtypes)["a"]
    return text_map(both, f"a {kind}, b {kind}", make, "tb", ("a", "b", "ta"))


def block_links(texts: list[str], label: list, asks: np.ndarray, idf: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (i, j) from texts i that ask to texts j of other labels: one for each i and label that has any.

    Similarities are exact: a shingle that occurs tf times is tf features of its idf, so the common weight of two
    sets is a product of 0/1 rows, summed over the features that two texts or more hold, 4096 at a time.
    """
    n, parts = len(texts), []
    for lo, hi in slices(texts):
        doc, shingle, tf = weighted_sets(texts[lo:hi])
        rep = np.repeat(np.arange(len(doc)), tf)
        level = np.arange(len(rep)) - np.repeat(np.cumsum(tf) - tf, tf)
        parts.append((doc[rep] + lo, shingle[rep], vec.mix(shingle[rep] + vec.mix(level.astype(np.uint64) + np.uint64(1)))))
    doc, shingle, feature = (np.concatenate(x) for x in zip(*parts, strict=True))
    weight = weight_of(shingle, idf).astype(float)
    total = np.bincount(doc, weight, n)
    _, first, inverse, held = np.unique(feature, return_index=True, return_inverse=True, return_counts=True)
    rank = np.cumsum(held > 1) - 1
    shared = held[inverse] > 1
    column, doc = rank[inverse[shared]], doc[shared]
    root = np.sqrt(weight[first[held > 1]])
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    common = np.zeros((int(asks.sum()), n))
    for lo in range(0, len(root), 4096):
        a, b = np.searchsorted(column, (lo, lo + 4096))
        x = np.zeros((n, min(4096, len(root) - lo)), np.float32)
        x[doc[a:b], column[a:b] - lo] = root[column[a:b]]
        common += x[asks] @ x.T
    rows = np.flatnonzero(asks)
    union = total[rows][:, None] + total[None, :] - common
    numbers = {x: k for k, x in enumerate(dict.fromkeys(label))}
    label = np.array([numbers[x] for x in label])
    hit = (common >= (threshold - 1e-7) * union) & (union > 0) & (label[rows][:, None] != label[None, :])
    out = {}
    for i, j in zip(*np.nonzero(hit), strict=True):
        out.setdefault((int(rows[i]), int(label[j])), int(j))
    return [(i, j) for (i, _), j in out.items()]


def outside_links(large: DataFrame, labels: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links of large buckets between nodes outside the largest class and nodes of any other class."""
    placed = large.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    placed = placed.join(texts.select("node", F.length("text").alias("chars")), "node")
    tally = placed.groupBy("band", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("chars").alias("chars"))
    shape = tally.groupBy("band").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.max("m").alias("top"), F.sum("m").alias("n"), F.sum("chars").alias("chars")).where("top < n")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_NODES, F.col("chars") / BLOCK_CHARS)).cast("int")
    ask_blocks = F.ceil(F.greatest((F.col("n") - F.col("top")) / BLOCK_NODES, F.col("chars") * (1 - F.col("top") / F.col("n")) / BLOCK_CHARS)).cast("int")
    shape = shape.select("band", "main", "n", blocks.alias("nb"), ask_blocks.alias("na"))
    shape = stored(shape, "bucket-shapes")
    dealt = stored(spread_join(placed, shape, "band", "node", shape.select("band", "n")), "outside")
    place = lambda of, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(of)).cast("int")
    every = F.sequence(F.lit(0), F.col("na") - 1)
    held = dealt.select("band", "node", "label", F.lit(False).alias("asks"), F.explode(every).alias("qa"), place("nb", 1).alias("mb"))
    asking = dealt.where("label != main").select("band", "node", "label", F.lit(True).alias("asks"), place("na", 2).alias("qa"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("mb"))
    both = held.unionByName(asking).join(texts, "node")
    kind = dict(large.dtypes)["node"]
    shared = large.sparkSession.sparkContext.broadcast(idf)

    def run(table):
        import pyarrow as pa

        ids, asks = table.column("node").to_pylist(), np.array(table.column("asks").to_pylist(), bool)
        found = []
        if asks.any():
            rows = [t or "" for t in table.column("text").to_pylist()]
            found = block_links(rows, table.column("label").to_pylist(), asks, shared.value, threshold)
        typ = table.schema.field("node").type
        return pa.table({"a": pa.array([ids[i] for i, _ in found], typ), "b": pa.array([ids[j] for _, j in found], typ)})

    return both.groupBy("band", "qa", "mb").applyInArrow(run, f"a {kind}, b {kind}").where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, for nodes with links.

    Each round takes the least label of the neighbours, then the label of that label; labels are stored every round.
    """
    ends = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    last = labels
    while True:
        near = ends.join(labels.select(F.col("node").alias("b"), F.col("label").alias("via")), "b").groupBy(F.col("a").alias("node")).agg(F.min("via").alias("m"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("to"))
        step = stored(low.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("to", "label")).alias("label")), "labels")
        done = step.where(F.col("label") != F.col("old")).isEmpty()
        forget(last)
        labels, last = step.select("node", "label"), step
        if done:
            forget(ends)
            return labels


def classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, class_id and copy_of (the least id with the same words) for every row.

    With ``keep``, those columns of ``df`` and ``class_key``, which names a class whether its rows have ids or not.
    """
    freq, n = document_frequencies(df, text)
    idf = inverse_frequencies(freq, n)
    sig = stored(signatures(df, idf, text, doc_id, keep), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__ra", "__rb"))
    alike = sig.groupBy("node").agg(least.alias("l"), F.count(F.lit(1)).alias("n"), F.any_value(F.struct("bands", "sketch")).alias("s"))  # equal words, equal samples
    nodes = stored(alike.select("node", F.col("l.doc_id").alias("least"), "l.__ra", "l.__rb", "n", "s.bands", "s.sketch"), "nodes")
    member = nodes.where("bands is not null").select("node", F.explode("bands").alias("band"))
    sizes = stored(member.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).where("n > 1"), "bucket-sizes")
    member = stored(spread_join(member, sizes, "band", "node", sizes.select("band", "n")), "buckets")
    star = member.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    leads = sizes.groupBy(F.col("lead").alias("a")).agg(F.sum("n").alias("n"))
    pairs = stored(agreeing(star.distinct(), nodes, leads), "pairs")
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    needed = needed.union(member.where("n > 2").select("node")).distinct()  # what the next step may ask for
    texts = stored(candidate_texts(df, nodes, needed, text, doc_id), "candidates")
    links = stored(verified(pairs, texts, idf, threshold), "links")
    labels = components(links)
    rest = stored(agreeing(apart(member.where((F.col("n") > 2) & (F.col("n") <= SMALL)), labels), nodes), "pairs")
    more = verified(rest, texts, idf, threshold)
    large = member.where(F.col("n") > SMALL).select("band", "node")
    if not large.isEmpty():
        more = more.union(outside_links(large, labels, texts, idf, threshold))
    more = stored(more, "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    forget(member, sizes, pairs, rest, texts)
    ids = labels.join(nodes.select("node", "least"), "node").groupBy("label").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n"))
    ids = stored(ids, "class-ids")
    linked = spread_join(labels, ids.select("label", "class_id"), "label", "node", ids.select("label", "n"))
    full = nodes.join(linked, "node", "left").select("node", F.col("least").alias("copy_of"), F.coalesce("class_id", "least").alias("class_id"), F.coalesce("label", "node").alias("class_key"))
    own = sig.select("doc_id", "node", *[F.col(quoted(c)) for c in keep])
    out = spread_join(own, full, "node", "doc_id", nodes.select("node", "n"))
    return out.select("doc_id", "class_id", "copy_of", *[F.col(quoted(c)) for c in keep], *(["class_key"] if keep else []))
