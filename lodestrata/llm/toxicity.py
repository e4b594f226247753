"""Toxicity (op 1): noisy-channel restoration of obfuscated words, then a score of the restored text.

A character trigram model is counted over every text of the corpus. Places that look obfuscated (digits or signs
before, among or behind letters, single characters with separators, letters repeated three times or more) become lattices: a sign may
stand for letters or for itself, a separator may part or join, a repeated letter may be dropped. The Viterbi path
under model and channel costs replaces the place. All other text has a lattice with one path, which is itself.

The score of the restored text is a logistic function of the log-odds of its words, for words whose association with
the label is significant. Labels come from training rows only, at most ``LABELLED`` of them (a documented bound).

Defined results: null and empty texts score as texts with no significant word; with no labelled rows every score is
the prior (0 with none of label 1); repeated rows give repeated results, and of rows that share an id the least text is
learned; texts and places of any length are restored whole; other columns are not read, whatever their names; an empty
table gives an empty table; null labels are not learned.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.llm import vec
from lodestrata.llm.common import text_map

#: Labelled rows learned from at most, and the G-squared from which a word counts. Each word that reaches it is in several
#: of these rows, so they bound the lexicon.
LABELLED, SIGNIFICANT = 12_000, 30.0
#: Symbols of the character model: 0 boundary, a-z, the letters U+00DF..U+00FF, 60 any other letter.
SYMBOLS = 64

# Letters that a digit or sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
# Channel costs (negative log probabilities): a sign for a letter, a sign as itself, a separator dropped or kept inside
# spaced letters, a repeated letter dropped or kept.
SIGN, PLAIN, JOIN, PART, DROP, REPEAT = 0.7, 2.0, 0.1, 3.0, 0.2, 1.5

#: Longest place whose restored form is remembered, in characters, after runs of one character are cut to four.
LONGEST = 32

_ONE = r"(?:[^\W\d_]|[0-9@$!])"
_SPACED = re.compile(rf"(?<![^\W_]){_ONE}(?:[ .\-_*]{{1,2}}{_ONE}){{3,}}(?![^\W_])")
_TOKEN = re.compile(r"[\w@$!|+(€£]+")
_INNER = re.compile(r"[0-9@$!|+(€£][^\W\d_]")
_BEHIND = re.compile(r"[^\W\d_][0-9@$!|+(€£]")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_RUN = re.compile(r"(.)\1{3,}", re.S)
_LETTER = re.compile(r"[^\W\d_]")


def symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    if "\xdf" <= c <= "\xff" and c != "\xf7":
        return ord(c) - 0xDF + 27
    return 60 if c.isalpha() else 0


def symbol_table() -> np.ndarray:
    kind, lower, _, _ = vec.tables()
    out = np.where(kind == vec.LETTER, 60, 0).astype(np.int64)
    for i in range(0x180):
        if kind[i] == vec.LETTER:
            out[i] = symbol(chr(lower[i]))
    return out


def trigrams(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Counts of symbol trigrams, runs of boundaries taken as one."""
    cp, _ = vec.codes([t + "\n" for t in texts])
    s = table[np.minimum(cp, vec._TOP - 1)]
    s = np.concatenate([[0, 0], s[(s > 0) | np.concatenate([[True], s[:-1] > 0])]])
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)


def costs(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b) by interpolated trigram, bigram and single counts."""
    c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 0.5) / (c1.sum() + 0.5 * SYMBOLS)
    p2 = (c2 + 4 * p1) / (c2.sum(axis=1, keepdims=True) + 4)
    p3 = (c3 + 4 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 4)
    return -np.log(p3).astype(np.float32)


@dataclass
class Restorer:
    """Viterbi decoding of lattices of obfuscated places."""

    cost: np.ndarray
    known: dict = field(default_factory=dict)

    def decode(self, place: str) -> str:
        place = _RUN.sub(lambda m: m[1] * 4, place.lower())
        if len(place) > LONGEST:
            return self.viterbi(place)
        if place not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[place] = self.viterbi(place)
        return self.known[place]

    def viterbi(self, place: str) -> str:
        """The text of the least path, in time linear in the place: paths share their beginnings as linked pairs.

        Signs behind the last letter are one boundary however many they are, as runs of boundaries are in the model.
        """
        states: dict = {(0, 0): (0.0, None)}
        before = ""
        drops = bool(_TRIPLE.search(place)) or bool(_INNER.search(place))  # plain words with a sign behind keep doubled letters
        tail = max((i + 1 for i, c in enumerate(place) if c.isalpha()), default=len(place))
        for i, c in enumerate(place):
            if c in LEET:
                options = [(x, SIGN) for x in LEET[c]] + [(c, PLAIN)]
            elif not c.isalnum():
                options = [("", JOIN), (" ", PART)]
            elif c == before and drops:
                options = [(c, REPEAT), ("", DROP)]
            else:
                options = [(c, 0.0)]
            again = c == before == "!" and i > tail  # a run of exclamation marks is one sign as itself
            before = c
            then: dict = {}
            for (a, b), (total, out) in states.items():
                for x, channel in options:
                    s = symbol(x) if x else 0
                    if x and (s or b or i < tail):
                        to, value = (b, s), total + channel + float(self.cost[a, b, s])
                    else:
                        to, value = (a, b), total + (0.0 if x and again else channel)
                    if to not in then or value < then[to][0]:
                        then[to] = (value, (out, x))
            states = then
        ends = [(v + (float(self.cost[a, b, 0]) if b or tail == len(place) else 0.0), out) for (a, b), (v, out) in states.items()]
        least = min(v for v, _ in ends)
        return min(spelled(out) for v, out in ends if v == least)

    def restore(self, text: str) -> str:
        text = _SPACED.sub(lambda m: self.replaced(m[0]), text)
        return _TOKEN.sub(lambda m: self.replaced(m[0]) if suspicious(m[0]) else m[0], text)

    def replaced(self, place: str) -> str:
        found = self.decode(place)
        return place if found == place.lower() else found

    def restore_all(self, texts: list[str]) -> list[str]:
        """``restore`` of each text. Texts that cannot hold a place are passed by: none of the patterns matches without
        a sign next to a letter, one letter three times, or two single characters at most three places apart."""
        kind = vec.tables()[0]
        cp, starts = vec.codes(texts)
        at = np.minimum(cp, vec._TOP - 1)
        letter = (kind[at] == vec.LETTER) | (kind[at] == vec.NUMBER) | (cp >= vec._TOP)  # at least what the patterns call letters
        sign = np.isin(cp, [ord(c) for c in LEET])
        flag = np.zeros(len(cp) + 1, bool)
        flag[:-2] |= sign[:-1] & letter[1:] & ~sign[1:] | letter[:-1] & ~sign[:-1] & sign[1:]
        flag[:-3] |= letter[:-2] & (cp[:-2] == cp[1:-1]) & (cp[1:-1] == cp[2:]) & ~sign[:-2]
        one = letter | sign
        alone = one.copy()  # a spaced run has four characters at least, and its inner ones stand alone
        alone[1:] &= ~one[:-1]
        alone[:-1] &= ~one[1:]
        where = np.flatnonzero(alone)
        near = where[:-1][np.diff(where) <= 3]
        flag[near] = True
        total = np.concatenate([[0], np.cumsum(flag[:-1])])
        hit = total[starts[1:]] > total[starts[:-1]]
        return [self.restore(t) if h else t for t, h in zip(texts, hit.tolist(), strict=True)]


def spelled(path: tuple | None) -> str:
    out = []
    while path:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


def suspicious(token: str) -> bool:
    """A digit or sign behind a letter, or before one of at least two letters, or a letter three times."""
    if len(token) < 3:
        return False
    return bool(_TRIPLE.search(token)) or bool(_BEHIND.search(token)) or bool(_INNER.search(token)) and len(_LETTER.findall(token)) >= 2


@dataclass
class Model:
    """words: sorted hashes with their log-odds; beta: bias and weights of the text's features."""

    cost: np.ndarray
    words: np.ndarray
    odds: np.ndarray
    beta: np.ndarray


def text_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, word hash) pairs."""
    w = vec.Words(texts)
    order = np.lexsort((w.h, w.doc))
    doc, h = w.doc[order], w.h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def features(doc: np.ndarray, odds: np.ndarray, n: int) -> np.ndarray:
    """Sum of positive log-odds (square root), largest, and sum of negative ones (square root), by text."""
    up = np.bincount(doc, np.maximum(odds, 0), n)
    down = np.bincount(doc, np.maximum(-odds, 0), n)
    top = np.zeros(n)
    np.maximum.at(top, doc, odds)
    return np.stack([np.ones(n), np.sqrt(up), top, np.sqrt(down)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 1e-2) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - y) + ridge * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta = beta - np.clip(step, -5, 5)
    return beta


def language_model(df: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts over every text of the corpus (at most SYMBOLS**3 numbers)."""

    def make():
        table, sums = symbol_table(), np.zeros(SYMBOLS**3, np.int64)

        def kernel(texts, kept):
            sums[:] += trigrams(texts, table)

        def finish():
            slots = np.flatnonzero(sums)
            return {"slot": slots, "n": sums[slots]}

        kernel.finish = finish
        return kernel

    counts = np.zeros(SYMBOLS**3, np.int64)
    tally = text_map(df, "slot int, n bigint", make, text, ()).groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[tally.column("slot").to_numpy()] = tally.column("n").to_numpy()
    return counts


def fit(df: DataFrame, labels: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", limit: int = LABELLED) -> Model:
    """Learn from labelled rows of ``df`` where ``train`` holds; the character model reads every text, no label."""
    from lodestrata.llm.common import stored

    cost = costs(language_model(df, text))
    spark = df.sparkSession
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    marks = marks.where(train).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    own = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(marks), "doc_id")  # at most `limit` ids
    own = own.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # of texts that share an id the least is learned

    def make():
        restorer = Restorer(cost_shared.value)

        def kernel(texts, kept):
            doc, h = text_words(restorer.restore_all(texts))
            parts = np.split(h.astype(np.int64), np.searchsorted(doc, np.arange(1, len(texts))))
            return {"y": kept["y"], "words": parts}

        return kernel

    cost_shared = spark.sparkContext.broadcast(cost)
    seen = stored(text_map(own, "y int, words array<bigint>", make, "text", ("y",)).withColumn("row", F.monotonically_increasing_id()), "toxicity-fit")
    n1, n = seen.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    n0 = n - n1
    if not n1 or not n0:
        prior = 30.0 if n1 else -30.0
        return Model(cost, np.zeros(0, np.uint64), np.zeros(0), np.array([prior, 0, 0, 0]))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    def cell(x, seen_in, total):
        """x * log(observed / expected) of one cell of the table word x label."""
        return F.when(x > 0, x * F.log(x * float(n) / (seen_in * float(total)))).otherwise(0.0)

    absent = F.lit(float(n)) - a - b
    g2 = 2 * (cell(a, a + b, n1) + cell(b, a + b, n0) + cell(float(n1) - a, absent, n1) + cell(float(n0) - b, absent, n0))
    tally = seen.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    chosen = tally.withColumn("g2", F.when(a + b < n, g2).otherwise(0.0)).where(F.col("g2") >= SIGNIFICANT).collect()
    words = np.array([r["w"] for r in chosen], np.int64).astype(np.uint64)
    odds = np.array([math.log((r["a"] + 0.5) / (n1 + 1)) - math.log((r["b"] + 0.5) / (n0 + 1)) for r in chosen])
    order = np.argsort(words)
    words, odds = words[order], odds[order]
    lexicon = spark.createDataFrame([(int(w), float(o)) for w, o in zip(words.astype(np.int64), odds, strict=True)], "w bigint, o double")
    hits = seen.select("row", F.explode("words").alias("w")).join(F.broadcast(lexicon), "w").groupBy("row").agg(F.collect_list("o").alias("o"))
    rows = seen.select("row", "y").join(hits, "row", "left").select("y", "o").collect()  # at most `limit` rows
    doc = np.repeat(np.arange(len(rows)), [len(r["o"] or ()) for r in rows])
    values = np.array([o for r in rows for o in sorted(r["o"] or ())], float)
    x, y = features(doc, values, len(rows)), np.array([r["y"] for r in rows], float)
    order = np.lexsort((*x.T, y))  # sums in one order, whatever order rows came in
    return Model(cost, words, odds, logistic(x[order], y[order]))


def score(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """doc_id, score, predicted, restored (whether restoring changed the text) and, if asked, the restored text."""
    schema = f"doc_id {dict(df.dtypes)[doc_id]}, score double, predicted int, restored boolean" + ", restored_text string" * with_text
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        restorer = Restorer(m.cost)

        def kernel(texts, kept):
            back = restorer.restore_all(texts)
            doc, h = text_words(back)
            at = np.minimum(np.searchsorted(m.words, h), max(len(m.words) - 1, 0))
            hit = m.words[at] == h if len(m.words) else np.zeros(len(h), bool)
            x = features(doc[hit], m.odds[at[hit]] if len(m.words) else np.zeros(0), len(texts))
            p = 1 / (1 + np.exp(-np.clip(x @ m.beta, -30, 30)))
            out = {"doc_id": kept[doc_id], "score": p, "predicted": (p >= 0.5).astype(np.int32), "restored": [a is not b and a != b for a, b in zip(back, texts, strict=True)]}
            if with_text:
                out["restored_text"] = back
            return out

        return kernel

    return text_map(df, schema, make, text, (doc_id,))
