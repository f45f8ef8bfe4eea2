"""SpotSigs fingerprints, with DataFrame functions only.

A text's words are its runs of letters and digits, lower-cased. Wherever a common word (an anchor) stands, and at the
start of the text, the next CHAIN content words (common words between them are passed over, SKIP at most in a row) form a
chain; the text's signatures are the hashes of its distinct chains, each with its anchor. The fingerprint is the sorted
set of signatures in hexadecimal, and the likeness of two fingerprints the Jaccard similarity of their sets. Sets whose
lengths alone keep them below the least likeness asked for are told apart without a comparison, and a join of many sets
only looks at partitions of neighbouring lengths and at the rarest signatures of each set.

Defined cases: a null or empty text has the empty fingerprint; a text without content words has one signature, of
itself; two empty fingerprints are alike (1), an empty and another one are not (0); equal texts have equal fingerprints;
repeated rows are documents of their own; ids that are null stand after all others; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranges
from .common import materialize
from .components import components

CHAIN, SKIP = 2, 8
#: Bytes of text that one task puts in order, on average, and the most ranges of ids that there are.
RANGE_BYTES, MOST_RANGES = 16 << 20, 1 << 16

# fixed values: common words of English, French, German and Spanish
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his",
    "in", "is", "it", "its", "not", "of", "on", "or", "she", "that", "the", "their", "they", "this", "to", "was", "we",
    "were", "which", "will", "with", "you",
    "au", "aux", "avec", "ce", "ces", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ne",
    "nous", "par", "pas", "pour", "que", "qui", "se", "son", "sur", "un", "une", "vous",
    "als", "auf", "aus", "bei", "das", "dem", "den", "der", "die", "ein", "eine", "einer", "er", "es", "für", "ich", "im",
    "ist", "mit", "nicht", "sich", "sie", "und", "von", "wie", "zu", "zum",
    "al", "como", "con", "del", "el", "lo", "los", "las", "más", "no", "o", "para", "por", "su", "sus", "y",
)


def signatures(text: Column) -> Column:
    """The sorted distinct signatures of a text, as numbers of 32 bits."""
    text = F.coalesce(text, F.lit(""))
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    marked = F.concat(F.lit("#^ "), F.array_join(F.transform(words, lambda w: F.when(w.isin(*ANCHORS), F.concat(F.lit("#"), w)).otherwise(w)), " "))
    following = rf"#(?=(\S+(?:(?: #\S+){{0,{SKIP}}}+ [^#\s]\S*+){{1,{CHAIN}}}+))"
    chains = F.transform(F.regexp_extract_all(marked, F.lit(following), 1), lambda c: F.regexp_replace(c, r" #\S+", ""))
    chains = F.when(F.size(chains) > 0, chains).otherwise(F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.transform(chains, lambda c: F.shiftrightunsigned(F.xxhash64(c), 32))))


def fingerprint(signed: Column) -> Column:
    return F.array_join(F.transform(signed, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """The Jaccard similarity of two sets; 0 where their lengths already keep it below `at_least`."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b)).cast("double")
    exact = F.when(large == 0, 1.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1.0)))
    return exact if at_least <= 0 else F.when(small >= F.lit(at_least) * large, exact).otherwise(0.0)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and signed of `docs`, with next_text and next_signed of the document of the next smaller id (equal ids by a hash of their text); the last one's next is the first."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"),
        ranges.hash52(text).alias("second"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
    )
    slim = materialize(keyed.select("key", "second", "size"), "ids")
    total = slim.agg(F.sum("size").alias("t")).first()["t"] or 0
    n = max(1, min(MOST_RANGES, total // RANGE_BYTES))
    placed, cells = ranges.cut(slim, "key", "second", "size", total, n, ["key", "second"])
    # cells ascend; the document after a cell's first one, in descending order, is the top of the cell before
    tops = {r["cell"]: r["top"] for r in placed.groupBy("cell").agg(F.max(F.struct("key", "second")).alias("top")).collect()}
    full = sorted(tops)
    after = dict(zip(full, full[1:] + full[:1], strict=True))
    each = range(sum(cells.parts))
    get = lambda values: ranges.lookup(values, F.col("cell"), "long")
    is_top = (F.col("key") == get([tops[c]["key"] if c in tops else None for c in each])) & (F.col("second") == get([tops[c]["second"] if c in tops else None for c in each]))
    here = F.struct(F.col("cell").alias("cell"), F.lit(1).alias("own"))
    there = F.struct(get([after.get(c, 0) for c in each]).cast("int").alias("cell"), F.lit(0).alias("own"))
    keyed = keyed.withColumn("cell", cells.cell(F.col("key"), F.col("second")))
    spread = keyed.withColumn("to", F.explode(F.when(is_top, F.array(here, there)).otherwise(F.array(here))))
    spread = spread.select("doc_id", "text", "key", "second", F.col("to.cell").alias("cell"), F.col("to.own").alias("own"))
    dealt = spread.repartition("cell").withColumn("signed", signatures(F.col("text")))
    order = Window.partitionBy("cell").orderBy("own", "key", "second")
    return dealt.withColumns({"next_text": F.lag("text").over(order), "next_signed": F.lag("signed").over(order)}).filter("own = 1").select("doc_id", "text", "signed", "next_text", "next_signed")


def compare_edits(docs: DataFrame) -> DataFrame:
    """For every document its fingerprint, that of its text with the last third replaced by the next document's start, and how alike it is to that and to the next document."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    found = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), "signed", "next_signed", edited.alias("edited"))
    found = found.withColumn("edited_signed", signatures(F.col("edited")))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("signed")).alias("fingerprint"),
        fingerprint(F.col("edited_signed")).alias("edited_fingerprint"),
        likeness(F.col("signed"), F.col("edited_signed")).alias("near_edited"),
        likeness(F.col("signed"), F.col("next_signed")).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, at_least: float = 0.75) -> DataFrame:
    """doc_id and component_id (smallest id reachable) of `docs`: documents are linked if their likeness is `at_least`.

    Equal sets are one class. Classes meet by their rarest signatures, of which two sets of this likeness share one among
    the first n - ceil(at_least * n) + 1, and by partition: partition k holds lengths from (1 / at_least)^k, and meets
    itself and the one before. Where they meet each class is first compared with the smallest id, which joins most of a
    group of copies; only classes that are not joined by then are compared with each other. Documents without signatures
    link with nothing.
    """
    step = math.log(1 / at_least)
    signed = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.col("text")).alias("signed")).filter("doc_id is not null"), "spots")
    classes = materialize(signed.filter(F.size("signed") > 0).groupBy("signed").agg(F.min("doc_id").alias("rep")), "classes")
    each = classes.select("rep", F.size("signed").alias("n"), F.explode("signed").alias("s"))
    common = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    rare = Window.partitionBy("rep").orderBy("df", "s")
    # signatures of one class alone link nothing, but they come first and use up the prefix
    alone = each.join(common, "s").withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("rep"))).withColumn("k", F.row_number().over(rare) + F.col("n") - F.col("left"))
    prefix = alone.filter(F.col("k") <= F.col("n") - F.ceil(F.lit(at_least) * F.col("n")) + 1)
    prefix = materialize(prefix.select("s", "rep", "n", F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("int").alias("part")), "prefixes")
    meeting = prefix.select("s", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "rep", "n")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, na, b, nb) the links u < v."""
        near = F.least("na", "nb") >= F.lit(at_least) * F.greatest("na", "nb")
        some = pairs.filter(near & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        sets = lambda c: classes.select(F.col("rep").alias(c), F.col("signed").alias(f"s{c}"))
        both = some.join(sets("u"), "u").join(sets("v"), "v")
        return materialize(both.filter(likeness(F.col("su"), F.col("sv"), at_least) >= at_least).select("u", "v"), "links")

    lead = meeting.groupBy("s", "part").agg(F.min(F.struct("rep", "n")).alias("lead"))
    first = linked(meeting.join(lead, ["s", "part"]).select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("lead.rep").alias("b"), F.col("lead.n").alias("nb")))
    labelled = meeting.join(components(first).withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = materialize(labelled, "labelled")
    open_ = labelled.groupBy("s", "part").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("s", "part")
    rest = labelled.join(open_, ["s", "part"], "left_semi")
    side = lambda c: rest.select("s", "part", F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("component").alias(f"of_{c}"))
    apart = side("a").join(side("b"), ["s", "part"]).filter("of_a < of_b")
    found = components(first.unionByName(linked(apart))).withColumnRenamed("node", "rep")
    of_class = classes.join(found, "rep", "left").select("signed", F.coalesce("component", "rep").alias("class_id"))
    return signed.join(of_class, "signed", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("component_id"))
