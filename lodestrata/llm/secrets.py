"""Secret scans (op 2), with DataFrame and SQL functions only.

Candidates are assignments to secret-like names, access keys, long hex runs (the base kinds), keys with a published
prefix, and opaque tokens. Each candidate value is hashed, and the corpus-wide table of hashes counts the distinct
repositories and owners that hold it: a value with many owners is a copied example, one kept to a few owners and with
enough different characters looks live. Base spans always stay; opaque tokens are spans only where they look live.

Positions come from the pieces between matches: ``split`` and ``regexp_extract_all`` walk a text the same way, so a
running sum of lengths (in code points) over a text's matches of a kind, a window that can spill, gives every span in
time linear in the matches. A value that many rows hold meets its counts by a broadcast of at most ``HOT`` values.

Defined results: a null text is empty and has no spans; null owners count as one owner; repeated rows give repeated
results, each counted as a holder only once; texts of any length are searched whole; spans of one start go by kind as
listed, then end; other columns are not read, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestrata.llm.common import stored

#: Owners from which a value counts as a copied example, and different characters that a live value has at least.
EXAMPLE_OWNERS, LIVE_CHARACTERS = 3, 8

# Kinds in the order of equal starts, with pattern, group of the secret and its least length. For hex and
# access the least length is in the pattern: their matches are whole runs, so it selects the same ones.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KNOWN = r"ghp_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"
OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}"
# What a value of a kind must hold besides, tested on the whole value.
HOLDS = {"opaque": ("[0-9]", "[a-z]", "[A-Z]")}
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24), ("known", KNOWN, 0, 1), ("opaque", OPAQUE, 0, 32))
BASE = ("assign", "access", "hex")

#: Values at most that are broadcast for having many holders: none has fewer than a HOT-th of all (value, holder) pairs.
HOT = 1000


def literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def marks(text: str, rank: int, pattern: str, group: int, least: int, holds: tuple[str, ...] = ()) -> Column:
    """Matches of one kind in the order of the text: (rank, characters since the match before, length, and of values that
    pass the hash and whether their characters vary enough)."""
    p = literal(pattern)
    value = f"regexp_extract_all({text}, {p}, {group})"
    passes = "".join(f" AND m.`1` RLIKE {literal(h)}" for h in holds)
    return F.expr(f"""
        CASE WHEN {text} RLIKE {p} THEN
          transform(filter(arrays_zip(regexp_extract_all({text}, {p}, 0), {value}, split({text}, {p}, -1)), m -> m.`0` IS NOT NULL),
            m -> named_struct('rank', {rank}, 'gap', length(m.`2`), 'length', length(m.`0`),
                              'hash', CASE WHEN length(m.`1`) >= {least}{passes} THEN sha2(m.`1`, 256) END,
                              'varied', size(array_distinct(split(m.`1`, ''))) >= {LIVE_CHARACTERS}))
        ELSE CAST(array() AS ARRAY<STRUCT<rank:INT, gap:INT, length:INT, hash:STRING, varied:BOOLEAN>>) END""")


def candidates(found: DataFrame) -> DataFrame:
    """row, rank, start, end, hash and varied of every candidate of the marked rows."""
    each = found.where(F.size("marks") > 0).select("row", F.posexplode("marks").alias("at", "m")).select("row", "at", "m.*")
    so_far = Window.partitionBy("row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("length")).over(so_far)
    return each.withColumn("end", end.cast("int")).where("hash is not null").select("row", "rank", (F.col("end") - F.col("length")).alias("start"), "end", "hash", "varied")


def ownership(found: DataFrame, owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """hash, n_repositories, n_owners, widespread: distinct repositories and owners that hold each value.

    Counts are taken in two steps, (value, owner, repository) then (value, owner), so a value that a third of all
    rows hold is spread by its holders before it is counted.
    """
    holders = found.select("repository", "owner", F.explode("marks.hash").alias("hash")).where("hash is not null")
    by_owner = holders.distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    counts = by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))
    return counts.withColumn("widespread", F.col("n_owners") >= owners)


def with_counts(each: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """Candidates with the counts of their value. Values of many holders are few by arithmetic and are broadcast; the
    others join by hash, so no task gets more than a value's share of a ``hot``-th."""
    counts = stored(counts, "secret-counts")
    edge = counts.agg(F.greatest(F.coalesce(F.sum("n_repositories"), F.lit(0)) / hot, F.lit(1.0))).first()[0]
    many = F.broadcast(counts.where(F.col("n_repositories") > edge))
    few = counts.where(F.col("n_repositories") <= edge)
    return each.join(many, "hash").unionByName(each.join(many.select("hash"), "hash", "left_anti").join(few, "hash"))


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", repository: str = "doc_id", owner: str = "source", owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """doc_id and secrets: array of (start, kind, end, hash, n_repositories, n_owners, class), sorted, for every row.

    class: ``example`` (many owners), ``live`` (few owners, varied characters) or ``weak``.
    """
    base = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    parts = [marks("t", i, pattern, group, least, HOLDS.get(kind, ())) for i, (kind, pattern, group, least) in enumerate(KINDS)]
    found = base.select("doc_id", "repository", "owner", F.concat(*parts).alias("marks"), F.monotonically_increasing_id().alias("row"))
    found = stored(found, "secrets")  # text-free and small; the texts are scanned once
    names = F.array(*[F.lit(k) for k, *_ in KINDS])
    each = with_counts(stored(candidates(found), "secret-spans"), ownership(found, owners))
    kind = F.element_at(names, F.col("rank") + 1)
    judged = each.withColumn("class", F.when(F.col("widespread"), "example").when(F.col("varied"), "live").otherwise("weak"))
    judged = judged.where((kind != "opaque") | (F.col("class") == "live"))
    one = F.struct("start", "rank", "end", kind.alias("kind"), "hash", "n_repositories", "n_owners", "class")
    per = judged.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("s"))
    fields = ("start", "kind", "end", "hash", "n_repositories", "n_owners", "class")
    full = per.select("row", F.transform("s", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("secrets"))
    empty = F.array().cast(dict(full.dtypes)["secrets"])
    some = found.where(F.size("marks") > 0).select("row", "doc_id").join(full, "row", "left")
    none = found.where(F.size("marks") == 0).select("doc_id", empty.alias("secrets"))
    return some.select("doc_id", F.coalesce("secrets", empty).alias("secrets")).unionByName(none)


def joined(spans: Column, only=None) -> Column:
    kept = spans if only is None else F.filter(spans, only)
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the spans as text, how many spans look live or copied, and by span how many repositories
    and owners hold its value, with its class."""
    s = F.col("secrets")
    kind = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    cls = lambda k: F.size(F.filter(s, lambda x: x["class"] == k)).cast("long")
    base = joined(s, lambda x: x["kind"].isin(*BASE))
    holders = F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["n_repositories"], x["n_owners"], x["class"])), ",")
    return found.select("doc_id", *[kind(k).alias(f"n_{k}") for k in BASE], F.sha2(base, 256).alias("base_sha256"), joined(s).alias("spans"), cls("live").alias("n_live"), cls("example").alias("n_example"), holders.alias("holders"))
