"""Document fingerprints after I-Match, in DataFrame functions only.

A document is known by its terms whose inverse document frequency lies in a band. Several random subsets of that lexicon
are drawn; for each, the document's distinct terms within it are sorted (by a code of 28 bits that stands for the term) and hashed. A subset holds one term in 16, 64, 128
or 256, so that short and long documents both have subsets which a small edit leaves alone; the last one is the whole lexicon, so
documents of different terms in the band never have one fingerprint. A text without a term in the band has there the hash of all its
sorted distinct terms. The fingerprint is the row of hashes; likeness is the share of equal ones among the subsets that either document
has terms in.

The lexicon holds terms in at least min_df of all documents, so it has at most (mean distinct terms a document) / min_df
of them at any corpus size. After a check of its size it becomes one value, a hash table of nested arrays, in which each document looks up
its terms in place; a lexicon beyond the check is joined to the exploded terms instead.

Documents are dealt into ranges of (doc_id, text hash) of about equal characters, so neither long documents nor a doc_id that many rows
share, or lack, fill one task.

Defined cases: a null text is empty and has the empty fingerprint, which is like itself alone; equal ids are ordered by text hash; a null
id comes first; the next document of the last is the first, and of an only document itself; repeated rows all stay; a very long text is
one document, its terms sorted on one task; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common

MIN_DF, MAX_DF = 0.0005, 0.4
RATES = tuple(r for r in (16, 64, 128, 256) for _ in range(8))
NONE = "00000000"
#: Characters that count as one document when ranges are cut.
PORTION = 8192
#: Above every code.
UNIT = 10**9
LOW = -(2**63)


def terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(text, common.WORD_SPACE)), lambda w: w != "")


def limits() -> list[str]:
    """For each subset, the number as eight hex digits below which a term's digits put it in the subset."""
    return [f"{(1 << 32) // r:08x}" for r in RATES]


def member_mask(term: Column) -> Column:
    """One bit for each subset that the term is in: eight digits of the md5 of the term and the subset's group of four."""
    groups = F.array(*[F.struct(F.lit(str(g)).alias("g"), *[F.lit(x).alias(f"l{i}") for i, x in enumerate(limits()[4 * g : 4 * g + 4])], *[F.lit(1 << (4 * g + i)).cast("long").alias(f"b{i}") for i in range(4)]) for g in range(len(RATES) // 4)])

    def add(acc: Column, g: Column) -> Column:
        # The inner aggregate over one element binds the digest, so it is computed once.
        digest = F.array(F.md5(F.concat(term, F.lit(":"), g["g"])))
        bits = lambda d: [F.when(F.substring(d, 8 * i + 1, 8) < g[f"l{i}"], g[f"b{i}"]).otherwise(F.lit(0).cast("long")) for i in range(4)]
        return F.aggregate(digest, acc, lambda a, d: (lambda b: a.bitwiseOR(b[0]).bitwiseOR(b[1]).bitwiseOR(b[2]).bitwiseOR(b[3]))(bits(d)))

    return F.aggregate(groups, F.lit(0).cast("long"), add)


def lexicon(docs: DataFrame, min_df: float = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """term, keys of the terms within the band: one key for each subset that the term is in, the whole lexicon being the last. A
    key is UNIT * (1 + subset) + code, where the code, by which terms are sorted and told apart in hashes, is 1 + 28 bits of the digest."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = df.filter((F.col("df") >= min_df * n) & (F.col("df") <= max_df * n))
    # Written first: the mask would else be computed below the grouping, for every occurrence of a term.
    band = common.settle(band.select("term"), "imatch-band")
    code = F.conv(F.substring(F.md5("term"), 1, 7), 16, 10).cast("long") + 1
    inside = F.filter(F.sequence(F.lit(0), F.lit(len(RATES) - 1)), lambda k: F.get(F.array(*[F.lit(1 << k).cast("long") for k in range(len(RATES))]), k).bitwiseAND(F.col("mask")) != 0)
    keys = F.transform(F.array_append(inside, F.lit(len(RATES))), lambda k: (k + 1) * F.lit(UNIT).cast("long") + F.col("code"))
    return common.settle(band.select("term", code.alias("code"), member_mask(F.col("term")).alias("mask")).select("term", keys.alias("keys")), "imatch-lexicon", terms=F.count("*"))


def hash_table(lex: DataFrame) -> tuple[Column, int]:
    """The lexicon as one value, array<array<struct<h, keys>>>, and its number of slots; a term's slot is its hash h modulo that.
    The caller has checked the size."""
    slots = max(1, 2 * lex.count())
    filled = lex.groupBy(_slot(F.xxhash64("term"), slots).alias("id")).agg(F.collect_list(F.struct(F.xxhash64("term").alias("h"), "keys")).alias("slot"))
    every = lex.sparkSession.range(slots).select(F.col("id").cast("int").alias("id")).join(filled, "id", "left")
    none = F.array().cast("array<struct<h:bigint,keys:array<bigint>>>")
    one = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("slot", none).alias("slot")))).alias("all"))
    return common.settle(one.select(F.transform("all", lambda x: x["slot"]).alias("all")), "imatch-table").scalar(), slots


def _slot(h: Column, slots: int) -> Column:
    return F.pmod(h, F.lit(slots)).cast("int")


def digest(words: Column) -> Column:
    return F.substring(F.md5(words), 1, 8)


def fingerprint(keys: Column, every: Column) -> Column:
    """keys: those of a document's terms in the lexicon; every: the digest of all its terms, NONE if it has none.

    One sort puts the keys in order by subset and code, behind a mark for each subset; spelled out, the marks cut them into subsets.
    """
    marks = F.array(*[F.lit((k + 1) * UNIT).cast("long") for k in range(len(RATES) + 1)])
    spelled = F.concat_ws(" ", F.sort_array(F.concat(marks, keys)).cast("array<string>"))
    parts = F.slice(F.split(spelled, rf"\b[0-9]{{1,2}}0{{{len(str(UNIT)) - 1}}}\b"), 2, len(RATES) + 1)
    hashes = F.transform(parts, lambda x: F.when(F.length(x) > 1, digest(F.trim(x))).otherwise(F.lit(NONE)))
    return F.concat(F.concat_ws("", F.slice(hashes, 1, len(RATES))), F.when(F.size(keys) > 0, F.get(hashes, F.lit(len(RATES)))).otherwise(every))


def _bytes(lex: DataFrame) -> int:
    """About the size of the lexicon's hash table: a term has less than two keys on average and at most 33."""
    return 120 * lex._watched["terms"]


def every(words: Column) -> Column:
    return F.when(F.size(words) > 0, digest(F.concat_ws(" ", F.sort_array(words)))).otherwise(F.lit(NONE))


def add_prints(rows: DataFrame, lex: DataFrame, within: int = common.BROADCAST_BYTES) -> DataFrame:
    """rows(bucket, pos, text, edited, ...) with fingerprint and edited_fingerprint in place of the texts."""
    keep = [c for c in rows.columns if c not in ("text", "edited")]
    names = ("fingerprint", "edited_fingerprint")
    if _bytes(lex) <= within:
        table, slots = hash_table(lex)

        def find(h: Column) -> Column:
            return F.get(F.filter(F.get("_table", _slot(h, slots)), lambda x: x["h"] == h), F.lit(0))["keys"]

        def of(words: Column) -> Column:
            hashes = F.transform(words, lambda t: F.xxhash64(t))
            keys = F.flatten(F.filter(F.transform(hashes, find), lambda x: x.isNotNull()))
            return F.get(F.transform(F.array(keys), lambda k: fingerprint(k, every(words))), F.lit(0))

        # One expression that refers to the table once: it is folded in, so that no row ever carries the table.
        both = F.transform(F.array(terms(F.col("text")), terms(F.col("edited"))), of)
        got = rows.withColumn("_table", table).select(*keep, both.alias("_both"))
        return got.select(*keep, *[F.col("_both")[i].alias(c) for i, c in enumerate(names)])
    rows = common.settle(rows.select(*keep, terms(F.col("text")).alias("fingerprint"), terms(F.col("edited")).alias("edited_fingerprint")), "imatch-terms")
    for c in names:
        word = rows.select("bucket", "pos", F.explode(c).alias("term")).join(lex, "term")
        got = word.groupBy(F.col("bucket").alias("_b"), F.col("pos").alias("_p")).agg(F.flatten(F.collect_list("keys")).alias("_found"))
        found = F.coalesce("_found", F.array().cast("array<bigint>"))
        rows = rows.join(got, (F.col("bucket") == F.col("_b")) & (F.col("pos") == F.col("_p")), "left").withColumn("_found", found)
        rows = rows.withColumn(c, fingerprint(F.col("_found"), every(F.col(c)))).drop("_b", "_p", "_found")
    return rows


def likeness(a: Column, b: Column) -> Column:
    starts = F.sequence(F.lit(1), F.lit(8 * len(RATES) + 1), F.lit(8))
    cut = lambda x, at: F.substring(x, at, F.lit(8))
    either = F.size(F.filter(starts, lambda at: (cut(a, at) != NONE) | (cut(b, at) != NONE)))
    same = F.size(F.filter(starts, lambda at: (cut(a, at) == cut(b, at)) & (cut(a, at) != NONE)))
    return F.when(either == 0, F.lit(1.0)).otherwise(same / either)


def _cuts(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Lower bounds (k, h) of ranges of rows(k, text) with about equal characters. A k that takes several ranges is cut by h, the text
    hash's first 60 bits."""
    portions = F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / PORTION).cast("int")))
    found = rows.select("k", portions).agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 20000).alias("b")).first()["b"] if parts > 1 else []
    out = []
    for k, times in sorted(Counter(found or []).items()):
        out += [(k, i * (1 << 60) // times) for i in range(times)]
    return out


def _bucket(cuts: list[tuple[int, int]]) -> Column:
    """The range of a row (k, h). Two steps against literal arrays, so a row compares with about 2 sqrt(cuts) bounds."""
    if not cuts:
        return F.lit(0)
    width = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    bounds = lambda xs: F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(h).cast("long").alias("h")) for k, h in xs])
    own = F.struct("k", "h")
    block = F.size(F.filter(bounds([b[0] for b in blocks]), lambda x: x <= own))
    inner = F.element_at(F.array(*[bounds(b) for b in blocks]), F.greatest(block, F.lit(1)))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * width + F.size(F.filter(inner, lambda x: x <= own)))


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, pos, extra, doc_id, text, next_text: rows in ascending doc_id order within ranges; a copy of each range's first
    row closes the range before it (extra), and the very first row closes the last."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("doc_id", F.lit(LOW)).cast("long").alias("k"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id"))
    cuts = _cuts(rows, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    hashed = F.md5("text")
    half = lambda at: F.conv(F.substring(hashed, at, 15), 16, 10).cast("long")
    rows = rows.withColumns({"h": half(1), "h2": half(16)})
    rows = rows.withColumn("own", _bucket(cuts).cast("int"))
    # The least row of each range: as many rows as ranges.
    least = {r["own"]: tuple(r["l"]) for r in rows.groupBy("own").agg(F.min(F.struct("k", "h", "h2")).alias("l")).collect()}
    used = sorted(least)
    before = dict(zip(used[1:] + used[:1], used, strict=True))
    row = lambda b: F.struct(*[F.lit(x).cast("long").alias(c) for x, c in zip(least.get(b, (0, 0, 0)), ("k", "h", "h2"), strict=True)])
    size = len(cuts) + 1
    first = F.element_at(F.array(*[row(b) for b in range(size)]), F.col("own") + 1)
    prior = F.element_at(F.array(*[F.lit(before.get(b, 0)).cast("int") for b in range(size)]), F.col("own") + 1)
    at = lambda b, extra: F.struct(b.alias("bucket"), F.lit(extra).alias("extra"))
    places = F.when(first == F.struct("k", "h", "h2"), F.array(at(F.col("own"), False), at(prior, True))).otherwise(F.array(at(F.col("own"), False)))
    rows = rows.withColumn("p", F.explode(places)).select("p.bucket", "p.extra", "k", "h", "h2", "doc_id", "text")
    order = Window.partitionBy("bucket").orderBy("extra", "k", "h", "h2")
    return rows.select("bucket", F.row_number().over(order).alias("pos"), "extra", "doc_id", "text", F.coalesce(F.lead("text").over(order), F.lit("")).alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text")
    lex = lexicon(docs)
    n, take = F.length("text"), (F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - take), F.substring(F.col("next_text"), F.lit(1), take))
    rows = with_next(docs).select("bucket", "pos", "extra", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    got = add_prints(rows.withColumn("edited_sha256", F.sha2("edited", 256)), lex)
    # Documents are in their ranges already, so this window shuffles nothing.
    nxt = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("pos"))
    out = got.withColumn("next", nxt).filter(~F.col("extra"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"))


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.documents(spark, sf_dir))


def op9_sql() -> str:
    inside = lambda k, r: f"(substr(md5(term || ':{k // 4}'), {8 * (k % 4) + 1}, 8) < '{limits()[k]}')"
    flags = ", ".join(f"{inside(k, r)} AS s{k}" for k, r in enumerate(RATES))
    whole = f"substr(md5(string_agg(({(len(RATES) + 1) * UNIT} + c)::VARCHAR, ' ' ORDER BY c)), 1, 8)"
    fps = " || ".join(f"coalesce(substr(md5(string_agg(({(k + 1) * UNIT} + c)::VARCHAR, ' ' ORDER BY c) FILTER (s{k})), 1, 8), '{NONE}')" for k in range(len(RATES))) + f" || {whole}"
    part = lambda x, k: f"substr({x}, {8 * k + 1}, 8)"

    def like(a: str, b: str) -> str:
        either = " + ".join(f"({part(a, k)} <> '{NONE}' OR {part(b, k)} <> '{NONE}')::INT" for k in range(len(RATES) + 1))
        same = " + ".join(f"({part(a, k)} = {part(b, k)} AND {part(a, k)} <> '{NONE}')::INT" for k in range(len(RATES) + 1))
        return f"CASE WHEN {either} = 0 THEN 1.0::DOUBLE ELSE ({same})::DOUBLE / ({either}) END"

    split = r"list_distinct(list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> ''))"
    bare = f"'{NONE * len(RATES)}' || CASE WHEN len({{0}}) = 0 THEN '{NONE}' ELSE substr(md5(array_to_string(list_sort({{0}}), ' ')), 1, 8) END"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS r FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY r), first_value(text) OVER (ORDER BY r)) AS nx FROM d),
e AS (SELECT *, left(text, length(text) - length(text) // 4) || left(nx, length(text) // 4) AS edited FROM n),
x AS (SELECT term, count(*) AS df FROM (SELECT unnest({split.format('text')}) AS term FROM d) GROUP BY term),
l AS (SELECT term, ('0x' || substr(md5(term), 1, 7))::BIGINT + 1 AS c, {flags} FROM x WHERE df >= {MIN_DF} * (SELECT count(*) FROM d) AND df <= {MAX_DF} * (SELECT count(*) FROM d)),
w AS (SELECT r, 0 AS w, unnest({split.format('text')}) AS term FROM e UNION ALL SELECT r, 1, unnest({split.format('edited')}) FROM e),
f AS (SELECT r, w, {fps} AS f FROM w JOIN l USING (term) GROUP BY r, w),
g AS (SELECT e.r, doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, coalesce(a.f, {bare.format(split.format('text'))}) AS fingerprint, coalesce(b.f, {bare.format(split.format('edited'))}) AS edited_fingerprint
  FROM e LEFT JOIN f a ON a.r = e.r AND a.w = 0 LEFT JOIN f b ON b.r = e.r AND b.w = 1),
h AS (SELECT *, coalesce(lead(fingerprint) OVER (ORDER BY r), first_value(fingerprint) OVER (ORDER BY r)) AS nf FROM g)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {like('fingerprint', 'edited_fingerprint')} AS near_edited, {like('fingerprint', 'nf')} AS near_next FROM h"""
