import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import bpe, decontam, langid, licenses, neardup, packing, pii, queries, secrets, telephony, tokencount, toxicity
from lodestrata.llm.common import held_out

SF = "/root/testdata/sf0.001"
ODD = ["", "x", None, "a\x00b", "don't  stop\n\n 'twas", "汉字 ½ é İ Σ", "<|endoftext|> hi", "word " * 3000, "same text here again", "same text here again", "!!! ???"]


def odd(spark):
    rows = [(i, t, "en", None, 5, "extra") for i, t in enumerate(ODD)] + [(None, "no id", None, "s", None, None), (3, "a\x00b", "en", "s", 3, "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    return dict(zip(t.doc_id, t.text, strict=True))


def test_tokenizers_agree(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    all_texts = [*texts.values(), *(t for t in ODD if t)]
    ids, first = bpe.Encoder(bpe.tokenizer_folder()).encode(all_texts)
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(all_texts):
        assert ids[first[i] : first[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert bpe.MergeCounter(public_tokenizers.path("word_bpe_49k.json")).count(all_texts).tolist() == [len(words.encode(t, add_special_tokens=False).ids) for t in all_texts]


def test_packing_is_whole(spark, texts):
    got = queries.op5_packing(spark, SF).toPandas()
    ids, first = bpe.Encoder(bpe.tokenizer_folder()).encode(list(texts.values()))
    own = {d: np.append(ids[first[i] : first[i + 1]], 0).astype("<u4") for i, d in enumerate(texts)}
    for d, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        assert g.start.tolist() == np.append(0, np.cumsum(g.length)[:-1]).tolist() and g.length.sum() == len(own[d]) == g.doc_tokens.iloc[0]
        assert all(zlib.crc32(own[d][s : s + n]) == c for s, n, c in zip(g.start, g.length, g.ids_crc32, strict=True))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == np.append(0, np.cumsum(g.length)[:-1]).tolist() and g.length.sum() <= 1024
    assert got.length.sum() / (1024 * got.sequence_id.nunique()) > 0.98


def test_level_choice_is_least():
    rng = np.random.default_rng(1)
    p = packing.SumOfSquares(32)
    p.counts[1:32] = rng.integers(0, 3, 31)
    for s in range(1, 33):
        def total(h):
            n = p.counts.copy()
            if h:
                n[h] -= 1
            if h + s < 32:
                n[h + s] += 1
            return int((n**2).sum())

        fits = [h for h in range(32 - s + 1) if h == 0 or p.counts[h]]
        assert total(p.level_for(s)) == min(map(total, fits))


def test_audio_round_trip(spark, texts):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for r in telephony.to_audio(d, with_media=True).limit(60).collect():
        raw = texts[r["doc_id"]].encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert telephony.payload_of(*telephony.load(r["media"])) == padded and r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(padded[-32:]) and r["media_bytes"] == len(r["media"])


def test_codec_tables():
    u, a = telephony.law_table(telephony.ULAW), telephony.law_table(telephony.ALAW)
    assert u[0xFF] == 0 and u[0x00] == -32124 and u[0x80] == 32124 and a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256
    block = np.zeros((1, 5), np.uint8)
    block[0, 4] = 0x07  # first nibble 7, then 0
    assert telephony.decode_ima(block)[0].tolist() == [0, 11, 13]


def base_secrets(t):
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secrets_base_and_ownership(spark):
    key = "ghp_" + "a1B2" * 9
    mixed = "Zx9+" * 9
    rows = ["é token = abc secret:token:abcdefgh 😀 AKIA" + "Q7" * 10, "f" * 30 + " password='hunter22'", "", None, f"{key} {mixed}", "api_key=short api-key=longenough apikey=longenough"]
    rows += [f"x {mixed[::-1]} y"] * 4
    d = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(rows)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(d)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        assert got[i]["base_sha256"] == hashlib.sha256(base_secrets(t or "").encode()).hexdigest()
    assert "known" in got[4]["spans"]
    assert all(got[i]["spans"] == "" for i in range(6, 10))  # opaque, with four owners: an example


def test_pii_patterns():
    t = "write a.b@c.de or x@y, 1.2.3.256 10.0.0.1, 4111 1111 1111 1111, +1 (555) 010-9999 iban DE89370400440532013000 ssn 123-45-6789"
    kinds = [k for *_, k, _ in pii.find(t)]
    assert kinds == ["email", "ip", "card", "phone", "iban", "ssn"]
    assert pii.redact("mail a@b.co now", pii.find("mail a@b.co now")) == "mail [EMAIL] now"
    assert pii.find("1" * 50_000 + "a" * 50_000 + "@") == []


def test_restoration_and_score(spark):
    words = ["idiot", "clown"]
    rows = [(i, f"the {words[i % 2]} was here with the people and the town {i}" if i % 2 == 0 else f"the garden was here with the people and the town {i}") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(200)], "doc_id long, toxic int")
    m = toxicity.fit(d, y, ~held_out(F.col("doc_id")))
    probe = spark.createDataFrame([(0, "such an 1d10t"), (1, "such an i d i o t here"), (2, "a garden"), (3, None), (4, "iiidiooot")], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(probe, m).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1}


def test_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d, langid.fit(d, ~held_out(F.col("doc_id"))), keep=("doc_id", "lang")).where(held_out(F.col("doc_id"))).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_licenses():
    index = licenses.Index(licenses.TEMPLATES)
    w = licenses.TEMPLATES["MIT"].split()
    t = " ".join(["foo bar baz"] * 5 + w[:20] + ["inserted"] + w[23:] + ["tail words"] * 4)
    (m,) = licenses.matches(index, [t])
    assert m[1] == "MIT" and m[2] > 0.9 and t[m[4] :].startswith("Permission is")
    assert licenses.matches(index, ["nothing to see here", ""]) == []


def similar_pairs(texts, idf):
    """(i, j) -> weighted Jaccard similarity of every pair of texts that share a run of words, by brute force."""
    bags = []
    for t in texts:
        _, s, tf = neardup.weighted_sets([t])
        bags.append(dict(zip(s.tolist(), (tf * neardup.weight_of(s, idf).astype(float)).tolist(), strict=True)))
    holders = {}
    for i, bag in enumerate(bags):
        for s in bag:
            holders.setdefault(s, []).append(i)
    pairs = {(i, j) for own in holders.values() for n, i in enumerate(own) for j in own[n + 1 :]}
    total = [sum(b.values()) for b in bags]
    out = {}
    for i, j in pairs:
        common = sum(min(v, bags[j][s]) for s, v in bags[i].items() if s in bags[j])
        out[i, j] = common / (total[i] + total[j] - common)
    return out


def brute_classes(n, pairs, threshold):
    """Least member of each text's component."""
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for (i, j), s in pairs.items():
        if s >= threshold:
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(30):
        base = [f"w{rng.integers(0, 5000)}" for _ in range(120)]
        for _ in range(4):
            own = list(base)
            for _ in range(int(rng.integers(0, 8))):
                own[int(rng.integers(0, 120))] = "edit"
            rows.append(" ".join(own))
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    idf = neardup.inverse_frequencies(*neardup.document_frequencies(d, "text"))
    want = brute_classes(len(rows), similar_pairs(rows, idf), neardup.THRESHOLD)
    assert len(set(want)) < len(rows)
    for small in (32, 2):  # the second goes by leaders and blocks
        monkeypatch.setattr(neardup, "SMALL", small)
        cls = {r["doc_id"]: r["class_id"] for r in neardup.classes(d).collect()}
        assert [cls[i] for i in range(len(rows))] == want


def test_near_duplicates_of_a_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in d.select("doc_id", "text").collect())
    idf = neardup.inverse_frequencies(*neardup.document_frequencies(d, "text"))
    pairs = similar_pairs([t for _, t in rows], idf)
    want = brute_classes(len(rows), pairs, neardup.THRESHOLD)
    cls = {r["doc_id"]: r["class_id"] for r in queries.op10_neardup(spark, "/root/testdata/sf0.01").collect()}
    assert sum(s >= 0.8 for s in pairs.values()) > 50
    assert [cls[i] for i, _ in rows] == [rows[k][0] for k in want]


def test_decontamination(spark):
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in b.collect()}
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, b).collect()}
    want = {(r["doc_id"], i) for r in d.collect() for i, t in items.items() if t in r["text"]}
    assert want <= got and len(got - want) <= 2
    kept = {r["doc_id"] for r in decontam.clean(d, b).collect()}
    assert kept == {r["doc_id"] for r in d.collect()} - {x for x, _ in got}
    assert decontam.subsequence([1, 2, 3, 4], [9, 1, 3, 9, 4]) == (3, [(0, 1), (2, 2), (3, 4)])


def test_odd_rows_and_empty_tables(spark):
    import corpus_pipeline

    for d in (odd(spark), odd(spark).where("false")):
        n = d.count()
        assert tokencount.count_tokens(d).count() == n
        assert pii.digest(pii.scan(d)).count() == n
        assert telephony.to_audio(d).count() == n
        assert licenses.scan(d).count() == 0
        assert secrets.digest(secrets.scan(d)).count() == n
        assert packing.pack(d).select("doc_id").count() >= n
        assert langid.identify(d, langid.fit(d, F.lit(True))).count() == n
        assert neardup.classes(d).count() == n
        y = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int")
        assert toxicity.score(d, toxicity.fit(d, y, F.lit(True))).count() == n
        assert corpus_pipeline.deduplicate(spark, d, SF).columns == d.columns
        assert corpus_pipeline.decontaminate(spark, d, SF).count() == n
        assert corpus_pipeline.remove_pii(spark, d, SF).count() == n


def test_copies_do_not_swell_the_language_sample(spark, monkeypatch):
    kept = []
    stored = langid.stored
    monkeypatch.setattr(langid, "stored", lambda df, what: kept.append(stored(df, what)) or kept[-1])
    words = [f"the river number {i} runs past the old mill" for i in range(40)]
    rows = [(i, words[i % 40], "en") for i in range(4000)] + [(9000 + i, f"der alte fluss fliesst durch das tal {i}", "de") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(d, F.lit(True), sample=40_000)
    assert kept[0].where("tf is not null").count() <= 3 * 60
    got = langid.identify(d, model, keep=("doc_id", "lang"))
    assert got.where("lang != lang_pred").count() == 0 and got.count() == 4020


def test_foreign_texts_of_all_lengths_are_rejected(spark):
    rng = np.random.default_rng(5)
    scripts = {"cyrillic": range(0x430, 0x450), "greek": range(0x3B1, 0x3CA), "arabic": range(0x627, 0x64B), "cjk": range(0x4E00, 0x5600), "consonants": [ord(c) for c in "bcdfghjklmnpqrstvwxz"]}
    foreign = [(n, s, " ".join("".join(chr(c) for c in rng.choice(list(cp), rng.integers(2, 9))) for _ in range(n))) for n in (10, 60, 400, 3000) for s, cp in scripts.items()]
    for sf in ("sf0.001", "sf0.01"):
        d = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        model = langid.fit(d, ~held_out(F.col("doc_id")))
        assert (model.floor > 0).all()
        _, _, rejected = model.predict([t for *_, t in foreign])
        assert [f[:2] for f, r in zip(foreign, rejected, strict=True) if not r] == []
        real = [r["text"] for r in d.where(held_out(F.col("doc_id")) & F.col("text").isNotNull()).select("text").collect()]
        _, _, rejected = model.predict([t for t in real if sum(map(str.isalpha, t)) >= 16])
        assert rejected.mean() < 0.005
        _, _, rejected = model.predict(prose := [t for t in real if len(set(t.split())) >= 5])
        assert rejected.sum() <= max(1, 0.002 * len(prose))


def test_places_of_any_length_and_trailing_signs_are_restored():
    texts = ["you are a worthless idiot and a dumbass and an ass", "the garden was here with the people and the town"] * 200
    r = toxicity.Restorer(toxicity.costs(toxicity.trigrams(texts, toxicity.symbol_table())))
    spaced = " ".join("worthlessidiot" + "worthlessidiot")
    wide = "  ".join("worthlessidiot")
    got = r.restore_all([f"so {spaced} here", f"so {wide} here", "what a dumba55", "you a$$ there", "Hello! page2 and Town!!", "x" + "1d" * 100_000])
    assert "".join(got[0].split()).count("worthlessidiot") == 2
    assert "worthless" in got[1] and "idiot" in got[1]
    assert got[2:5] == ["what a dumbass", "you ass there", "Hello! page2 and Town!!"]


def test_repeated_license_lines():
    index = licenses.Index(licenses.TEMPLATES)
    line = licenses.TEMPLATES["MIT-notice"]
    for n in (2, 3, 40):
        got = licenses.matches(index, [" ".join([line] * n)])
        assert [(m[1], m[4], m[5]) for m in got] == [("MIT-notice", i * (len(line) + 1), i * (len(line) + 1) + len(line) - 1) for i in range(n)]
    (a, b) = licenses.matches(index, [f"Licensed under a CC BY 4.0. {licenses.TEMPLATES['CC-BY-4.0']}"])
    assert a[1] == b[1] == "CC-BY-4.0" and a[5] <= b[4]


def test_opaque_tokens_are_judged_whole(spark):
    rows = ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "12345678", "abcdefghijklmABCDEFGHIJKLM" + "12345678", "abcdefghijklmnopqrstuvwxyz" * 2 + "12345678", "ghijklmnop1234" * 4 + "B"]
    d = spark.createDataFrame([(i, f"x {t} y", f"s{i}") for i, t in enumerate(rows)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan(d)).collect()}
    assert got == {0: "opaque:2:62", 1: "opaque:2:36", 2: "", 3: "opaque:2:59"}
