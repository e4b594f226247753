"""Adversarial texts, odd rows and clashing names, for every operator and every pipeline stage."""

import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import bpe, common, decontam, langid, licenses, neardup, packing, pii, secrets, telephony, tokencount, toxicity, vec

SF = "/root/testdata/sf0.001"
SF1 = "/root/testdata/sf0.01"


def thue_morse(n, a, b):
    return [(a, b)[i.bit_count() % 2] for i in range(n)]


def test_polynomial_collisions_are_not_collisions():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for a, b in ("ab", "ex", "th", "01", "!?"):
        for n in (1024, 2048, 4096):
            pair = ["".join(thue_morse(n, a, b)), "".join(thue_morse(n, b, a))]
            ids, first = bpe.Encoder(bpe.tokenizer_folder()).encode(pair)
            counts = bpe.MergeCounter(public_tokenizers.path("word_bpe_49k.json")).count(pair)
            for i, t in enumerate(pair):
                assert ids[first[i] : first[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids
                assert counts[i] == len(words.encode(t, add_special_tokens=False).ids)


def test_texts_of_two_words_are_told_apart(spark):
    yes, no = (" ".join(thue_morse(4096, *w)) for w in (("yes", "no"), ("no", "yes")))
    d = spark.createDataFrame([(1, yes), (2, no), (3, yes)], "doc_id long, text string")
    assert {r["doc_id"]: r["copy_of"] for r in neardup.classes(d).collect()} == {1: 1, 2: 2, 3: 1}


def test_many_short_texts_in_an_untuned_session(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text")).coalesce(1)
    assert neardup.classes(d).agg(F.countDistinct("class_id")).first()[0] == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_slices_bound_rows_and_characters():
    assert list(common.slices([""] * 10, 5, 4)) == [(0, 4), (4, 8), (8, 10)]
    assert list(common.slices(["abc", "de", "x" * 9, ""], 5, 4)) == [(0, 2), (2, 3), (3, 4)]


def test_prefilter_of_restoration_passes_nothing_by():
    texts = [t or "" for t in pq.read_table(f"{SF1}/documents.parquet").column("text").to_pylist()]
    texts += ["i. d i. o t", "(i d i o t)", "½ i. d- i_ o t", "1d10t " * 40, "idi0", "assh0", "aaa", "x @ y @ z @ q", "", "a  b  c  d", "\u4e00 \u4e8c \u4e09 \u56db"]
    r = toxicity.Restorer(toxicity.costs(toxicity.trigrams(texts, toxicity.symbol_table())))
    assert r.restore_all(texts) == [r.restore(t) for t in texts]
    assert r.restore_all(["i. d i. o t"]) == ["idiot"]


def brute_decode(r, place):
    """Least cost over all readings of a place, one by one."""
    place = re.sub(r"(.)\1{3,}", lambda m: m[1] * 4, place.lower())
    drops = bool(toxicity._TRIPLE.search(place)) or bool(toxicity._INNER.search(place))
    tail = max((i + 1 for i, c in enumerate(place) if c.isalpha()), default=len(place))
    readings = [(0.0, 0, 0, "")]
    for i, c in enumerate(place):
        if c in toxicity.LEET:
            options = [(x, toxicity.SIGN) for x in toxicity.LEET[c]] + [(c, toxicity.PLAIN)]
        elif not c.isalnum():
            options = [("", toxicity.JOIN), (" ", toxicity.PART)]
        elif i and c == place[i - 1] and drops:
            options = [(c, toxicity.REPEAT), ("", toxicity.DROP)]
        else:
            options = [(c, 0.0)]
        then = []
        for cost, a, b, out in readings:
            for x, channel in options:
                s = toxicity.symbol(x) if x else 0
                if x and (s or b or i < tail):
                    then.append((cost + channel + float(r.cost[a, b, s]), b, s, out + x))
                else:
                    then.append((cost + (0.0 if x and c == "!" and i and place[i - 1] == "!" and i > tail else channel), a, b, out + x))
        readings = then
    return min((cost + (float(r.cost[a, b, 0]) if b or tail == len(place) else 0.0)) for cost, a, b, _ in readings), {out for *_, out in readings}


def test_viterbi_against_all_readings():
    texts = ["you are a worthless idiot and a dumbass and an ass", "the garden was here with the people and the town"] * 50
    r = toxicity.Restorer(toxicity.costs(toxicity.trigrams(texts, toxicity.symbol_table())))
    rng = np.random.default_rng(4)
    signs = "".join(toxicity.LEET)
    for _ in range(120):
        word = str(rng.choice(["idiot", "worthless", "ass", "town", "people"]))
        place = "".join(str(rng.choice(list(signs))) if rng.random() < 0.3 else c * int(rng.choice([1, 1, 1, 3])) for c in word)
        if not any(c.isalpha() for c in place) or len(place) > 14:
            continue
        least, outs = brute_decode(r, place)
        got = r.viterbi(re.sub(r"(.)\1{3,}", lambda m: m[1] * 4, place.lower()))
        assert got in outs
        again, _ = brute_decode(r, place)
        assert again == least


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for k, pattern, least, most in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (k == 3 or luhn(digits)):
                out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.BASE[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_personal_data_against_brute_force(spark):
    d = spark.read.parquet(f"{SF1}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in d.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["base_sha256"] for r in pii.digest(pii.scan(d)).collect()}
    assert got == {i: hashlib.sha256(base_pii(t).encode()).hexdigest() for i, t in texts.items()}
    rng = np.random.default_rng(6)
    made = ["".join(rng.choice(list("0123456789. -+@ab()%"), 60)) for _ in range(400)]
    d = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r["doc_id"]: r["base_sha256"] for r in pii.digest(pii.scan(d)).collect()}
    assert got == {i: hashlib.sha256(base_pii(t).encode()).hexdigest() for i, t in enumerate(made)}


def test_ownership_against_brute_force(spark):
    rng = np.random.default_rng(8)
    keys = ["".join(rng.choice(list("0123456789abcdef"), 32)) for _ in range(12)]
    rows = [(i, " ".join(f"x {keys[k]}" for k in rng.integers(0, 12, rng.integers(0, 4)) ** 2 % 12), f"s{rng.integers(0, 5)}") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    holders = {}
    for i, t, s in rows:
        for m in re.findall("[0-9a-f]{24,}", t):
            holders.setdefault(hashlib.sha256(m.encode()).hexdigest(), set()).add((i, s))
    for hot in (1000, 3):  # the second broadcasts the most common values
        found = secrets.with_counts(secrets.candidates(marked := common.stored(marks_of(d), "t")), secrets.ownership(marked), hot)
        got = {r["hash"]: (r["n_repositories"], r["n_owners"]) for r in found.where("rank = 2").collect()}
        assert got == {h: (len({i for i, _ in v}), len({s for _, s in v})) for h, v in holders.items()}


def marks_of(d):
    parts = [secrets.marks("text", i, p, g, n, secrets.HOLDS.get(k, ())) for i, (k, p, g, n) in enumerate(secrets.KINDS)]
    return d.select("doc_id", F.col("doc_id").cast("string").alias("repository"), F.col("source").alias("owner"), F.concat(*parts).alias("marks"), F.monotonically_increasing_id().alias("row"))


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token={i:08x}" for i in range(20_000))
    d = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    (row,) = secrets.digest(secrets.scan(d)).collect()
    assert row["n_assign"] == 20_000 and row["spans"].endswith(f"assign:{len(text) - 14}:{len(text)}")


def test_licenses_against_every_place():
    """The banded alignment finds the best stretch that a full alignment over the text finds."""
    rng = np.random.default_rng(9)
    name = "ISC"
    words = licenses.TEMPLATES[name].split()
    index = licenses.Index({name: licenses.TEMPLATES[name]})
    for _ in range(40):
        own = list(words)
        for _ in range(int(rng.integers(0, 6))):
            k = int(rng.integers(0, len(own)))
            own[k : k + int(rng.integers(0, 2))] = ["other"] * int(rng.integers(0, 2))
        text = [f"w{k}" for k in rng.integers(0, 50, int(rng.integers(0, 40)))] + own + [f"w{k}" for k in rng.integers(0, 50, int(rng.integers(0, 40)))]
        w = vec.Words([" ".join(text)])
        n, m = len(index.words[0]), len(w.h)
        score = np.zeros((n + 1, m + 1), int)
        for i in range(1, n + 1):
            score[i, 0] = -i
            for j in range(1, m + 1):
                score[i, j] = max(score[i - 1, j - 1] + (2 if index.words[0][i - 1] == w.h[j - 1] else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
        best = score[n].max()
        (got,) = licenses.matches(index, [" ".join(text)])
        matched = got[3]
        assert 3 * matched - n >= best  # a template word that is not matched costs at least one
        assert licenses.COVERAGE * n <= matched <= decontam.subsequence(index.words[0].tolist(), w.h.tolist())[0]


def planted(items, rng, share, shuffle=False):
    out = []
    for k, t in enumerate(items):
        w = t.split()
        for i in rng.choice(len(w), int(share * len(w)), replace=False):
            w[i] = f"zz{rng.integers(0, 10**6)}"
        if shuffle:  # the first two quarters change places
            a = len(w) // 4
            w[:a], w[a : 2 * a] = w[a : 2 * a], w[:a]
        out.append(" ".join([f"filler{rng.integers(0, 500)}" for _ in range(60)] + w + [f"filler{rng.integers(0, 500)}" for _ in range(60)]))
    return out


def test_paraphrases_are_found(spark):
    b = spark.read.parquet(f"{SF1}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in b.collect()}
    rng = np.random.default_rng(10)
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    model = decontam.fit(docs)
    for share, shuffle in ((0.0, False), (0.08, False), (0.16, False), (0.24, False), (0.0, True)):
        texts = planted(items.values(), rng, share, shuffle)
        d = spark.createDataFrame([(i, t) for i, t in zip(items, texts, strict=True)], "doc_id long, text string")
        got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, b, model).collect()}
        assert sum((i, i) in got for i in items) / len(items) >= 0.95
    clean = spark.createDataFrame([(i, " ".join(f"filler{rng.integers(0, 500)}" for _ in range(150))) for i in range(50)], "doc_id long, text string")
    assert decontam.contaminated(clean, b, model).count() == 0


def test_retrieval_keeps_what_brute_force_finds(spark):
    """Every window is aligned with every item, without the latent space; the search finds at least 0.95 of that."""
    docs, b = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/benchmark.parquet")
    model = decontam.fit(docs)
    items = decontam.items_of(sorted((r["item_id"], r["text"]) for r in b.collect()), model.projection, model.idf)
    texts = [r["text"] or "" for r in docs.collect()]
    every, found = set(), set()
    for lo, hi in common.slices(texts):
        every |= {(lo + x[0], x[1]) for x in decontam.search(texts[lo:hi], items, model.projection, model.idf, -2.0)}
        found |= {(lo + x[0], x[1]) for x in decontam.search(texts[lo:hi], items, model.projection, model.idf)}
    assert found <= every and len(found & every) >= 0.95 * len(every) and every


NAMES = "score lang_pred rejected pii redacted class_id class_key copy_of node band bands n row hash start end length secrets cands marks label `odd.name`".split()


def odd_rows(spark, n_chars=True, extra=True, empty=False):
    texts = ["", "x", None, "a\x00b", "汉字 ½ é İ Σ", "<|endoftext|> hi", "word " * 3000, "same text here again and again for all", "same text here again and again for all", "!!! ???", "mail a.b@c.de token=abcdefgh +1 555 010 9999 Released under the MIT License."]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s") for i, t in enumerate(texts)]
    rows += [(None, "no id at all in this row", "en", "s"), (None, "no id at all in this row", None, "s"), (None, None, None, None), (5, "another text under the id five", "en", "t"), (3, "a\x00b", None, "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    if n_chars:
        d = d.withColumn("n_chars", F.length("text").cast("long"))
    if extra:
        d = d.select("*", *[F.lit(k).alias(c.strip("`")) for k, c in enumerate(NAMES)])
    return d.where("false") if empty else d


OPERATORS = {
    "op1": lambda s, d: toxicity.score(d, toxicity.fit(d, s.createDataFrame([(1, 1), (2, None), (5, 0)], "doc_id long, toxic int"), F.lit(True)), with_text=True),
    "op2": lambda s, d: secrets.digest(secrets.scan(d)),
    "op3": lambda s, d: telephony.to_audio(d, with_media=True),
    "op4": lambda s, d: licenses.scan(d),
    "op5": lambda s, d: packing.pack(d, with_ids=True),
    "op6": lambda s, d: pii.digest(pii.scan(d, redacted=True)),
    "op7": lambda s, d: langid.identify(d, langid.fit(d, F.lit(True))),
    "op8": lambda s, d: decontam.contaminated(d, s.read.parquet(f"{SF}/benchmark.parquet")),
    "op9": lambda s, d: tokencount.count_tokens(d),
    "op10": lambda s, d: neardup.classes(d),
}
STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("shape", ["plain", "clashing", "empty"])
def test_operators_take_odd_rows(spark, name, shape):
    d = odd_rows(spark, extra=shape != "plain", empty=shape == "empty")
    got = OPERATORS[name](spark, d).collect()
    n = d.count()
    if name in ("op4", "op8"):
        assert len(got) == (1 if name == "op4" and n else 0)
    elif name == "op5":
        assert {r["doc_id"] for r in got} == {r["doc_id"] for r in d.collect()} and len(got) >= n
    else:
        assert len(got) == n


@pytest.mark.parametrize("name", STAGES)
@pytest.mark.parametrize("shape", ["plain", "clashing", "bare", "empty"])
def test_stages_take_odd_rows(spark, name, shape):
    d = odd_rows(spark, n_chars=shape != "bare", extra=shape == "clashing", empty=shape == "empty")
    got = STAGES[name](spark, d, SF)
    n = d.count()
    if name == "packing":
        assert got.count() >= n
        return
    assert got.columns == d.columns and got.dtypes == d.dtypes
    rows = got.collect()
    if name == "near_duplicates" and n:
        # one of the copies of ids 7 and 8, of the rows without id, of "a\x00b", and of the empty ones stays
        assert sorted((r["text"] or "") for r in rows) == sorted({(r["text"] or "") for r in d.collect()})
        assert [r["doc_id"] for r in rows if r["text"] and r["text"].startswith("same")] == [7]
    elif name == "language":
        assert all(r["text"] for r in rows)
    else:
        assert len(rows) == n


@pytest.mark.parametrize("name", [x for x in STAGES if x != "packing"])
def test_stages_keep_columns_of_any_name_and_type(spark, name):
    d = odd_rows(spark, extra=False).select(
        "*",
        F.lit(1).alias("a`b"),
        F.lit("z").alias("c, d"),
        F.struct(F.lit(1).alias("p q"), F.col("source").alias("r`s")).alias("st st"),
        F.create_map(F.lit("k"), F.col("doc_id")).alias("m"),
        F.array(F.col("lang")).alias("x.y"),
        F.lit(1.25).cast("decimal(9,3)").alias("dec"),
        F.lit("2024-02-29 01:02:03").cast("timestamp").alias("at"),
        F.encode("lang", "UTF-8").alias("bin"),
    )
    got = STAGES[name](spark, d, SF)
    assert got.dtypes == d.dtypes
    plain = lambda r: repr([v for c, v in zip(r.__fields__, r, strict=True) if c not in ("text", "n_chars")])
    known = {plain(r) for r in d.collect()}
    assert {plain(r) for r in got.collect()} <= known and (name == "language" or got.count())


def test_pipeline_end_to_end(spark):
    """Every stage by brute force on the stage before: rows kept, texts changed, pieces whole."""
    out = corpus_pipeline.run(spark, SF1).toPandas()
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    model = langid.fit(docs, ~common.held_out(F.col("doc_id")))
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["text"]), key=lambda r: r[0])
    rejected = model.predict([t for _, t in rows])[2]
    rows = [r for r, bad in zip(rows, rejected, strict=True) if not bad]
    kept = spark.createDataFrame(rows, "doc_id long, text string")
    cls = {r["doc_id"]: r["class_id"] for r in neardup.classes(kept).collect()}
    rows = [r for r in rows if cls[r[0]] == r[0]]
    kept = spark.createDataFrame(rows, "doc_id long, text string")
    bad = {r["doc_id"] for r in decontam.contaminated(kept, spark.read.parquet(f"{SF1}/benchmark.parquet")).collect()}
    rows = [(i, pii.redact(t, pii.find(t))) for i, t in rows if i not in bad]
    ids, first = bpe.Encoder(bpe.tokenizer_folder()).encode([t for _, t in rows])
    sizes = {i: int(n) + 1 for (i, _), n in zip(rows, np.diff(first), strict=True)}
    assert out.groupby("doc_id").length.sum().to_dict() == sizes
    assert (out.groupby("sequence_id").length.sum() <= 1024).all()


def test_templates_from_a_table(spark):
    rows = [("house", "all rights in this work belong to the house of words"), ("house", "zzz"), (None, "x"), ("empty", None)]
    table = spark.createDataFrame(rows, "name string, text string")
    d = spark.createDataFrame([(1, "so all rights in this work belong to the house of words here")], "doc_id long, text string")
    (m,) = licenses.scan(d, templates=table).collect()
    assert (m["license"], m["start"], m["coverage"]) == ("house", 3, 1.0)
    with pytest.raises(ValueError, match="at most"):
        licenses.template_table(table, most=10)
    assert licenses.scan(d, templates={}).count() == 0
    (m,) = licenses.matches(licenses.Index(licenses.TEMPLATES), ["// SPDX-License-Identifier: BSD-3-Clause"])
    assert m[1] == "SPDX-BSD-3-Clause"
