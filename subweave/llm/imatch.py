"""I-Match fingerprints over randomised lexicon subsets, with DataFrame functions only.

Document frequencies are counted over all documents. The lexicon is the terms in a band of inverse document frequency: a term
of it is in at least one of every `rarest` documents, so there are at most `rarest` times as many as a document has distinct terms
on average, however many documents there are. It is sent in buckets by hash, so a document's terms are looked up one by one.

A fingerprint has one hash for each of SUBSETS random families of nested subsets of the lexicon. A family gives every term
a level, high ones being rare; its subsets are the terms from a level on. The document's hash is that of its sorted distinct terms in
the smallest subset of the family that has any of them, so long and short documents both have a few terms in it. A document
without lexicon terms has all its terms treated in the same way. The likeness of two fingerprints is the part of their hashes
that agree.

Terms are words without white space, in lower case, known by their 64-bit hash.

Nulls, empties, ties: a null text is empty; all empty texts have one fingerprint. Rows are fingerprinted one by one, also repeated
ones. The next document follows by descending doc_id, of equal ids by ascending text, ids that are null last; after the last comes
the first. Columns other than the id and the text are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subweave.store import stored

#: The band: in at least one of so many documents, in at most one of so many.
RAREST, COMMONEST = 200, 10
#: Families of subsets, and bits of a level in each; together those of a long.
SUBSETS, LEVEL_BITS = 16, 4
#: Terms of one bucket of the lexicon, about.
BUCKET = 4
#: Rows of one stretch of the order by id.
STRETCH_ROWS, MOST_STRETCHES = 2048, 10_000

def terms(text: Column) -> Column:
    """Hashes of the text's words, with repeats."""
    flat = F.lower(text)
    for c in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.transform(F.array_remove(F.split(flat, " "), ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, text_col: str = "text", rarest: int = RAREST, commonest: int = COMMONEST) -> list[int]:
    """The terms of the band in ascending order."""
    n = docs.count()
    found = docs.select(F.explode(F.array_distinct(terms(F.col(text_col)))).alias("t")).groupBy("t").count()
    band = found.where((F.col("count") * rarest >= n) & (F.col("count") * commonest <= n))
    return sorted(r["t"] for r in band.select("t").collect())


def _literal(values: list[int]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def buckets(known: list[int]) -> tuple[Column, int]:
    """The lexicon as an array of arrays, and how many: a term is in the one of its remainder."""
    n = max(1, len(known) // BUCKET)
    out: list[list[int]] = [[] for _ in range(n)]
    for t in known:
        out[t % n].append(t)
    return F.from_json(F.lit("[" + ",".join(f"[{','.join(map(str, x))}]" for x in out) + "]"), "array<array<bigint>>"), n


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _level(mark: Column, family: int) -> Column:
    return F.shiftright(mark, LEVEL_BITS * family).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))


def _slot(marks: Column, family: int) -> Column:
    top = F.array_max(F.transform(marks, lambda x: _level(x, family)))
    return _let(top, lambda t: F.xxhash64(F.filter(marks, lambda x: _level(x, family) == t), F.lit(family)))


def hashes(text: Column, known: tuple[Column, int]) -> Column:
    """A hash for each family of subsets; known is the lexicon in buckets."""
    own, n = known
    inside = lambda t: F.array_contains(F.get(own, F.pmod(t, F.lit(n)).cast("int")), t)
    # a bit of a mark is set for one term in four, so high levels are rare; a mark still tells terms apart
    mark = lambda t: t.bitwiseAND(F.xxhash64(t))
    used = lambda words: _let(F.filter(words, inside), lambda some: F.when(F.size(some) > 0, some).otherwise(words))
    slots = lambda marks: F.array(*(_slot(marks, m) for m in range(SUBSETS)))
    return _let(F.array_distinct(terms(text)), lambda words: _let(F.sort_array(F.transform(used(words), mark)), slots))


def written(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v)
    return F.size(same) / F.lit(float(SUBSETS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rarest: int = RAREST, commonest: int = COMMONEST) -> DataFrame:
    """doc_id, text and its fingerprint (hashes, an array of long)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("hashes", hashes(F.col("text"), buckets(lexicon(rows, rarest=rarest, commonest=commonest))))


def _stretch(bounds: list[int], doc_id: Column) -> Column:
    """How many of the ascending bounds are at most doc_id, by binary search; -1 where it is null."""
    if not bounds:
        return F.when(doc_id.isNull(), F.lit(-1)).otherwise(F.lit(0))
    all_, steps = _literal(bounds), [1 << k for k in reversed(range(len(bounds).bit_length()))]
    go = lambda at, step: F.when((at + step <= len(bounds)) & (F.element_at(all_, F.least(at + step, F.lit(len(bounds)))) <= doc_id), at + step).otherwise(at)
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), go))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rarest: int = RAREST, commonest: int = COMMONEST) -> DataFrame:
    """For each document its text and hashes, those of its text with the last half from the next document, and the next document's hashes."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = buckets(lexicon(base, rarest=rarest, commonest=commonest))
    n = min(MOST_STRETCHES, math.ceil(base.count() / STRETCH_ROWS))
    cuts = base.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n).alias("b")).first()["b"] if n > 1 else None
    rows = base.withColumn("stretch", _stretch(sorted(set(cuts or ())), F.col("doc_id")))
    # the first text of each stretch, for the last document of the one above it
    first_ids = rows.groupBy("stretch").agg(F.max("doc_id").alias("first_id"))
    heads = rows.join(first_ids.withColumnRenamed("stretch", "of"), F.expr("stretch = of and doc_id <=> first_id")).groupBy("stretch").agg(F.min("text").alias("head"))
    heads = stored(heads, "heads")
    order = Window.orderBy("stretch")
    top = heads.agg(F.max("stretch").alias("top"))
    above = heads.select("stretch").withColumn("under", F.lag("stretch").over(order))
    above = above.join(F.broadcast(top)).select(F.col("stretch").alias("above"), F.coalesce("under", "top").alias("under"))
    following = heads.join(above, F.col("stretch") == F.col("under")).select(F.col("above").alias("stretch"), F.col("head").alias("following"), hashes(F.col("head"), known).alias("following_hashes"))
    down = Window.partitionBy("stretch").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    hashed = rows.withColumn("hashes", hashes(F.col("text"), known))
    led = hashed.select("*", F.lead("text").over(down).alias("next"), F.lead("hashes").over(down).alias("next_hashes"))
    whole = led.join(following, "stretch", "left").select("doc_id", "text", "hashes", F.coalesce("next", "following").alias("next"), F.coalesce("next_hashes", "following_hashes").alias("next_hashes"))
    chars = F.length("text").cast("long")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (chars - half).cast("int")), F.substring("next", F.lit(1), half))
    return whole.select("doc_id", "text", "hashes", "next_hashes", chars.alias("n_chars"), edited.alias("edited")).withColumn("edited_hashes", hashes(F.col("edited"), known))
