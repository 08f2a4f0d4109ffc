"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text is a sequence of tokens: runs of up to 16 characters without white space together
with the space after them, so the tokens hold the whole text. Its k-mers are `K` tokens
in a row; equal k-mers are numbered by their occurrence. The k-mers are dealt by hash into
`PARTS` parts (one permutation instead of many); of each part the `PICK` occurrence-numbered
k-mers with the least hashes are selected, put back into text order, and hashed as a tuple.
The likeness of two fingerprints is the share of equal tuples among the parts that
either text fills.

The document after each one (ascending doc_id; after the last: the first) is found without
a global window: documents are dealt into ranges of doc_id, and the first document of
each range also goes, as a guest, to the range before. A doc_id (or null) that many rows
share is dealt into ranges of a hash of the text.

Edge cases: null texts count as empty; an empty text fills no part, its fingerprint is
all zeros, and two such fingerprints have likeness 1. A null doc_id ranks first. Rows that share
a doc_id follow each other in a fixed order of their texts; repeated rows follow each other. A
single document is followed by itself. Of texts of more than 2^24 tokens the order of k-mers is
known to 1/2^24 of their length. Only doc_id and the text are read, so other columns may have
any names. Ties between k-mers' hashes are ties of equal k-mers, which their numbers break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoframe.llm import common

K, PARTS, PICK = 3, 64, 2
POSITION = 24  # bits of a k-mer's place; 33 bits of its hash (HASH) and 6 of its part stand above them
HASH = 33


def sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the array `out`: an int per part, 0 for a part without k-mers.

    Every step is a column of its own that the next one names several times, so that the planner keeps it as
    computed and doesn't write it into lambdas."""
    own = [c for c in df.columns if c != out]
    low, top = (1 << POSITION) - 1, POSITION + HASH
    named, dealt = (1 << HASH) - 1, (1 << HASH + 6) - 1
    kept = 63 << top | low  # part and place
    df = df.select(*own, F.expr(f"transform(regexp_extract_all({text}, '\\\\S{{1,16}}\\\\s*|\\\\s+', 0), x -> xxhash64(x))").alias("_h"))
    df = df.select(*own, "_h", F.expr(f"greatest(0, length(bin(size(_h))) - {POSITION})").alias("_b"))  # bits of a place that don't fit
    row = ", ".join(f"_h[i + {j}]" for j in range(K))
    df = df.select(*own, F.expr(f"""CASE WHEN size(_h) >= {K} THEN
        sort_array(transform(sequence(0, size(_h) - {K}), i -> shiftleft(xxhash64({row}) & {dealt}L, {POSITION}) | shiftright(i, _b)))
        WHEN size(_h) > 0 THEN array(shiftleft(xxhash64(_h) & {dealt}L, {POSITION})) ELSE array() END""").alias("_s"))
    run = f"shiftright(_s[i], {POSITION})"
    df = df.select(*own, "_s", F.expr(f"concat(filter(sequence(0, greatest(size(_s) - 1, 0)), i -> size(_s) > 0 AND (i = 0 OR {run} <> shiftright(_s[i - 1], {POSITION}))), array(size(_s)))").alias("_r"))
    # a number for each occurrence of a k-mer; the hash of both stands in the place of the k-mer's, below its part
    numbered = f"""sort_array(flatten(transform(sequence(1, greatest(size(_r) - 1, 1)), g ->
        CASE WHEN size(_r) < 2 THEN array()
        WHEN _r[g] - _r[g - 1] = 1 THEN array((_s[_r[g - 1]] & {kept}L) | shiftleft(xxhash64(shiftright(_s[_r[g - 1]], {POSITION}), 0) & {named}L, {POSITION}))
        ELSE transform(sequence(_r[g - 1], _r[g] - 1), i -> (_s[i] & {kept}L) | shiftleft(xxhash64({run}, i - _r[g - 1]) & {named}L, {POSITION})) END)))"""
    df = df.select(*own, F.expr(numbered).alias("_e"))
    df = df.select(*own, "_e", F.expr(f"concat(filter(sequence(0, greatest(size(_e) - 1, 0)), i -> size(_e) > 0 AND (i = 0 OR shiftright(_e[i], {top}) <> shiftright(_e[i - 1], {top}))), array(size(_e)))").alias("_p"))
    name = lambda i: f"(shiftright(_e[{i}], {POSITION}) & {named}L)"
    first, second = "_p[g - 1]", "_p[g - 1] + 1"
    tuples = f"""transform(sequence(1, greatest(size(_p) - 1, 1)), g -> CASE WHEN size(_p) < 2 THEN CAST(NULL AS struct<part:int,h:int>) ELSE named_struct('part', CAST(shiftright(_e[{first}], {top}) AS INT), 'h',
        CAST(1 + pmod(CASE WHEN _p[g] - _p[g - 1] < {PICK} THEN xxhash64({name(first)})
          WHEN (_e[{first}] & {low}) < (_e[{second}] & {low}) THEN xxhash64({name(first)}, {name(second)})
          ELSE xxhash64({name(second)}, {name(first)}) END, 2147483646L) AS INT)) END)"""
    # the map is an argument of a lambda, so it is made once and not for each part
    spread = f"transform(array(map_from_entries(filter({tuples}, x -> x IS NOT NULL))), m -> transform(sequence(0, {PARTS - 1}), p -> coalesce(m[p], 0)))[0]"
    return df.select(*own, F.expr(spread).alias(out))


def likeness(a: str, b: str) -> Column:
    """The share of equal tuples among the parts that either fingerprint fills; 1 if none is filled."""
    either = F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x <> 0 OR y <> 0), x -> x))")
    same = F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x <> 0 AND x = y), x -> x))")
    return F.when(either == 0, F.lit(1.0)).otherwise(same / either)


def as_text(a: str) -> Column:
    return F.expr(f"array_join(transform({a}, x -> lpad(lower(hex(x)), 8, '0')), '')")


def followed(docs: DataFrame, text: str, carried: list[str], each: int = 32 << 20) -> DataFrame:
    """docs with next_<column> for text and the carried columns: those of the document after, by _rank."""
    spark = docs.sparkSession
    wanted = max(4 * common.shuffle_partitions(spark), common.size_in_bytes(docs) // each)
    coarse = min(wanted, 256)
    span = docs.select("_rank").agg(F.count("*").alias("n"), F.max("_rank").alias("last"), F.percentile_approx("_rank", [k / coarse for k in range(coarse)], 10000).alias("cuts")).first()
    if not span["n"]:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in (text, *carried)])
    cuts = sorted(set(span["cuts"]))
    often = [span["cuts"].count(x) for x in cuts]  # a rank that is several cuts has that share of all rows
    fine = -(-wanted // len(cuts))
    stride = (max(often) + 1) * fine + 2
    near, share = F.array(*[F.lit(x).cast("long") for x in cuts]), F.array(*map(F.lit, often))
    after_ = F.array(*[F.lit(x).cast("long") for x in (*cuts[1:], span["last"])])
    docs = docs.withColumn("_c", F.greatest(F.lit(1), F.size(F.filter(near, lambda x: x <= F.col("_rank")))))
    low, high, many = F.element_at(near, F.col("_c")), F.element_at(after_, F.col("_c")), F.element_at(share, F.col("_c"))
    hot = (many > 1) & (F.col("_rank") == low)
    # only where a rank is hot are texts hashed for their order
    docs = docs.withColumn("_h", F.when(hot, F.xxhash64(text)).otherwise(F.lit(0).cast("long")) if max(often) > 1 else F.lit(0).cast("long"))
    within = F.when(high > low, F.floor((F.col("_rank").cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double")) * fine)).otherwise(0)
    within = many * fine + F.greatest(F.lit(0), F.least(F.lit(fine), within))
    dealt = F.least(many * fine - 1, F.floor((F.col("_h").cast("double") + 2.0**63) / 2.0**64 * many * fine))
    docs = docs.withColumn("_range", (F.col("_c") * stride + F.when(hot, dealt).otherwise(within)).cast("long")).drop("_c")
    # a row of a few numbers per range (one for 32 MB of input, some MB of rows for 100 TB): the range before, where the first is a guest
    order = Window.orderBy("_range")
    firsts = docs.groupBy("_range").agg(F.min(F.struct("_rank", "_h")).alias("f"))
    guests = firsts.select(F.col("f._rank").alias("_first"), F.col("f._h").alias("_hash"), F.coalesce(F.lag("_range").over(order), F.max("_range").over(Window.partitionBy())).alias("_before"))
    docs = docs.join(F.broadcast(guests), (F.col("_rank") == F.col("_first")) & (F.col("_h") == F.col("_hash")), "left")
    at = F.array(F.struct(F.lit(0).alias("guest"), F.col("_range").alias("at")))
    both = F.when(F.col("_before").isNotNull(), F.concat(at, F.array(F.struct(F.lit(1).alias("guest"), F.col("_before").alias("at"))))).otherwise(at)
    own = [c for c in docs.columns if c not in ("_range", "_first", "_hash", "_before")]
    dealt = docs.select(*own, F.explode(both).alias("_at")).select(*own, "_at.guest", "_at.at")
    after = Window.partitionBy("at").orderBy("guest", "_rank", "_h", text)
    return dealt.select(*own, "guest", *[F.lead(c).over(after).alias(f"next_{c}") for c in (text, *carried)]).where("guest = 0").drop("guest", "_h")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    size = common.size_in_bytes(docs)
    docs = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col("doc_id"), F.lit(-2**63)).cast("long").alias("_rank"))
    docs = followed(sketch(docs, "text", "_own"), "text", ["_own"])
    half = F.floor(F.length("text") / 2).cast("int")
    docs = docs.withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    docs = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "_edited", F.sha2(F.col("_edited"), 256).alias("edited_sha256"), "_own", "next__own")
    docs = sketch(docs, "_edited", "_new")
    return common.few_files(docs.select("doc_id", "n_chars", "edited_sha256", as_text("_own").alias("fingerprint"), as_text("_new").alias("edited_fingerprint"),
                       likeness("_own", "_new").alias("near_edited"), likeness("_own", "next__own").alias("near_next")), 4 * size)


def op5_document_fingerprints(spark, sf_dir):
    return fingerprints(common.table(spark, sf_dir, "documents"))
