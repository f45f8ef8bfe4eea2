r"""Personal data by bootstrapped contextual extraction.

Expressions find the seed entities (email, ip, card, phone). Any other string that could be an identifier, a run of
numbers, a name with an at sign in any spelling or a word with digits, is a candidate of no kind. Around a string stand
its lexical patterns: the word before it, the two words before it, the word after it; and its own shape is one (digits
written as 9, where it has no letters). Spark keeps the graph of patterns and instances (normalised strings) as a table
and scores both in turn for ROUNDS rounds:

- a pattern's confidence in a kind is what speaks for it over all that is there plus SMOOTHING. A seed of the kind speaks
  for it, one of another kind against it. A candidate speaks for it with the score that the round before has given it, 0
  at first; the rest of it speaks against, wholly if it has not the look of the kind or its shape is the pattern, else by
  OPEN. A pattern counts from CONFIDENT on, if SUPPORT instances or more are behind it;
- a candidate's score for a kind is 1 - product(1 - confidence * plausibility) over its patterns that count.

So patterns that seeds have induced propose whatever stands in their slot, whatever its form. Instances of a score of CONFIDENT
or more then induce the patterns around all their occurrences, as seeds do: a pattern is looked at in a round if it has BACKERS
seeds or such instances of a kind, so that contexts without any seed are found from what was discovered in others. Plausibility is 1 for what has the kind's number of digits and no letters (of an email, an at sign), else
UNLIKELY: an odd string needs more than one pattern.

A candidate is reported, as the kind of its highest score, where the patterns around it or all those of its instance give
it CONFIDENT. Seeds are always reported.

Names before an at sign are read up to 64 characters, as mail allows.

Defined cases: a null or empty text has no spans; spans count code points and end before `end`; equal matches of two
kinds are both kept; of kinds of equal score the first of KINDS counts; repeated rows and null ids are kept as they are;
extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SMOOTHING, SUPPORT, CONFIDENT, OPEN = 3, 1.0, 8, 0.8, 0.25
#: Seeds and confident instances of a kind that a pattern is looked at for, and what a string counts for that has not the look of a kind.
BACKERS, UNLIKELY = 3, 0.5
#: Numbers of digits that kinds have.
DIGITS = {"ip": (4, 12), "card": (12, 19), "phone": (7, 15)}
#: A word of context is cut here: longer ones are no words.
CONTEXT_CHARS = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never starts inside a run of digits: the run's start would have matched
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What may be an identifier: numbers that follow each other, names with an at sign, words with digits.
_CANDIDATES = (
    re.compile(r"[+(]{0,2}[0-9](?:[ ./()-]{0,2}[0-9]++)*+"),
    re.compile(r"[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]|\(@\)) ?[A-Za-z0-9-]{1,63}+(?:(?: ?(?:\(dot\)|\[dot\]) ?|\.)[A-Za-z0-9-]{1,63}+)*+"),
    re.compile(r"[0-9]\S*"),
)
_AT = re.compile(r"\(at\)|\[at\]|\(@\)")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base entities, in order."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        if at > done and text[at - 1] in _LOCAL and (m := _DOMAIN.match(text, at + 1)):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def identifiers(text: str) -> list[tuple[str, str, bool, int, int, list[str]]]:
    """Seeds and candidates: kind (`other` of candidates), normalised string, whether a seed, start, end, patterns."""
    if not any(c in text for c in "0123456789@") and "at)" not in text and "at]" not in text:
        return []
    found = seeds(text)
    out = [(KINDS[k], s, e, True) for s, k, e in found]
    taken = bytearray(len(text))
    for s, _, e in found:
        taken[s:e] = b"\1" * (e - s)
    for n, expression in enumerate(_CANDIDATES):
        at, stop = 0, len(text)
        while m := expression.search(text, at, stop):
            s, e = m.span()
            if (hit := taken.find(1, s, e)) == s:  # goes on behind what is taken
                at = e if (at := taken.find(0, s)) < 0 else at
                continue
            if hit > 0:  # ends before it
                stop = hit
                continue
            at, stop = e, len(text)
            while n == 2 and s and m.start() - s < CONTEXT_CHARS and not text[s - 1].isspace() and not taken[s - 1]:
                s -= 1
            # part of a word is no run of numbers
            if n == 0 and (s and text[s - 1].isalnum() or e < len(text) and text[e].isalnum()):
                continue
            out.append(("other", s, e, False))
            taken[s:e] = b"\1" * (e - s)
    return [(kind, value(text[s:e]), seed, s, e, patterns(text, s, e)) for kind, s, e, seed in out]


def value(string: str) -> str:
    """A string as an instance: letters, digits and at signs."""
    return re.sub(r"[^0-9a-z@]", "", _AT.sub("@", string.lower()))


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a string: the word before, the two words before, the word after, and its shape."""
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 2 * CONTEXT_CHARS - 4) : start])[-2:]]
    after = [w.lower() for w in _WORD.findall(text[end : end + CONTEXT_CHARS + 4])[:1]]
    shape = [] if end - start > CONTEXT_CHARS or _WORD.search(text, start, end) else ["S:" + re.sub("[0-9]", "9", text[start:end])]
    return [f"L:{w}" for w in before[-1:]] + [f"LL:{' '.join(before)}"] * (len(before) == 2) + [f"R:{w}" for w in after] + shape


_ENTITY = pa.struct([("kind", pa.string()), ("value", pa.string()), ("seed", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("patterns", pa.list_(pa.string()))])
ENTITIES = "array<struct<kind:string,value:string,seed:boolean,start:long,end:long,patterns:array<string>>>"


def _quick(text: str | None) -> list:
    if not text:
        return []
    keys = ("kind", "value", "seed", "start", "end", "patterns")
    return [dict(zip(keys, x, strict=True)) for x in identifiers(text)]


def _find(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            found = [_quick(t) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found, pa.list_(_ENTITY))], names=[*batch.schema.names[1:], "found"])


def plausible(kind: Column, value_: Column) -> Column:
    """How much a string looks like a kind: 1 or UNLIKELY."""
    digits = F.length(F.regexp_replace(value_, "[^0-9]", ""))
    number = ~value_.rlike("[a-z@]")
    looks = F.when(kind == "email", value_.contains("@"))
    for k, (least, most) in DIGITS.items():
        looks = looks.when(kind == k, number & digits.between(least, most))
    return F.when(looks, 1.0).otherwise(UNLIKELY)


def _together(confidence: Column) -> Column:
    """1 - product(1 - confidence)."""
    return 1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - confidence))))


def score(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Iterative scoring of the pattern-instance graph `edges` (pattern, kind, value, seed), distinct rows.

    Returns the patterns that count (pattern, kind, confidence) and the candidates' scores (kind, value, score).
    """
    edges = materialize(edges, "edges")
    seeded = F.when(F.col("seed"), F.col("kind"))
    by_seed = edges.filter("seed").groupBy("pattern").agg(F.count(seeded).alias("seeded"), *[F.count_if(seeded == k).alias(k) for k in KINDS])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("seeds")) for k in KINDS]))
    by_seed = materialize(by_seed.select("pattern", "seeded", each.alias("x")).select("pattern", "seeded", "x.*"), "seeds")
    open_ = edges.filter("not seed").select("pattern", "value")
    scores = sure = None
    for _ in range(ROUNDS):
        # what stands behind a pattern: seeds, and what the round before was confident of
        able = by_seed.withColumn("found", F.lit(0).cast("long"))
        if scores is not None:
            confident = scores.filter(F.col("score") >= CONFIDENT).select("kind", "value")
            induced = open_.join(confident, "value").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("found"))
            other = by_seed.select("pattern", F.col("seeded").alias("all_seeds")).distinct()
            able = by_seed.join(induced, ["pattern", "kind"], "full").join(other, "pattern", "left")
            able = able.select("pattern", F.coalesce("seeded", "all_seeds", F.lit(0)).alias("seeded"), "kind", F.coalesce("seeds", F.lit(0)).alias("seeds"), F.coalesce("found", F.lit(0)).alias("found"))
        # few backers make no pattern confident, and keep the graph from growing
        able = materialize(able.filter(F.col("seeds") + F.col("found") >= BACKERS), "patterns")
        graph = open_.join(able.select("pattern", "kind"), "pattern")
        look = plausible(F.col("kind"), F.col("value"))
        weight = F.when((look < 1) | F.col("pattern").startswith("S:"), 1.0).otherwise(OPEN)
        graph = materialize(graph.select("pattern", "kind", "value", look.alias("look"), weight.alias("weight")), "candidates")
        if scores is None:
            scores = graph.select("kind", "value").limit(0).withColumn("score", F.lit(0.0))
        s = F.coalesce("score", F.lit(0.0))
        backed = graph.join(scores, ["kind", "value"], "left").groupBy("pattern", "kind")
        backed = backed.agg(F.sum(s).alias("more"), F.sum(F.col("weight") * (1 - s)).alias("against"), F.count_if(s >= 0.5).alias("n"))
        more, against, n = (F.coalesce(c, F.lit(0)) for c in ("more", "against", "n"))
        confidence = (F.col("seeds") + more) / (F.col("seeded") + more + against + SMOOTHING)
        sure = able.join(backed, ["pattern", "kind"], "left").filter((confidence >= CONFIDENT) & (F.col("seeds") + n >= SUPPORT))
        sure = materialize(sure.select("pattern", "kind", confidence.alias("confidence")), "confident")
        found = graph.join(sure, ["pattern", "kind"]).groupBy("kind", "value").agg(_together(F.col("confidence") * F.col("look")).alias("score"))
        scores = materialize(found, "instances")
    return sure, scores


def _extract(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`kept`, a struct of the columns `keep`, and `spans`."""
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")
    rows = docs.select("text", kept)
    found = rows.mapInArrow(_find, f"kept {rows.schema['kept'].dataType.simpleString()}, found {ENTITIES}")
    # a row's number, written with it, ties its spans to what is discovered about it
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "entities")
    each = found.select("row", F.explode("found").alias("x")).select("row", "x.*")
    by_pattern = each.select("row", "kind", "value", "seed", "start", "end", F.explode("patterns").alias("pattern"))
    sure, scores = score(by_pattern.select("pattern", "kind", "value", "seed").distinct())
    open_ = by_pattern.filter("not seed").select("row", "start", "end", "value", "pattern")
    place = ["row", "start", "end", "kind"]
    by_context = open_.join(sure, "pattern").groupBy(*place).agg(_together(F.col("confidence") * plausible(F.col("kind"), F.col("value"))).alias("score"))
    by_instance = each.filter("not seed").select("row", "start", "end", "value").join(scores, "value").select(*place, "score")
    rank = F.create_map(*[F.lit(x) for k, n in enumerate(KINDS) for x in (n, -k)])
    best = by_context.unionByName(by_instance).filter(F.col("score") >= CONFIDENT).groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("score", rank[F.col("kind")])).alias("kind"))
    # a group is what one text has
    new = best.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", F.lit(False).alias("seed"))).alias("new"))
    # written, so that its size is known: texts are not shuffled to meet a few spans
    new = materialize(new, "discovered")
    base = F.transform(F.filter("found", lambda x: x["seed"]), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["seed"].alias("seed")))
    none = F.expr("cast(array() as array<struct<kind:string,start:long,end:long,seed:boolean>>)")
    return found.join(new, "row", "left").select("kept", in_order(F.concat(base, F.coalesce("new", none))).alias("spans"))


def extract(docs: DataFrame) -> DataFrame:
    """doc_id and `spans` of every row of `docs` (doc_id, text): array of (kind, start, end, seed) by start, then kind as in KINDS."""
    return _extract(docs, ["doc_id"]).select("kept.doc_id", "spans")


def in_order(spans):
    rank = F.create_map(*[F.lit(x) for k, n in enumerate(KINDS) for x in (n, k)])
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["seed"].alias("seed")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["seed"].alias("seed")))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, of the base entities, a hash of them, and all spans."""
    base = F.filter("spans", lambda x: x["seed"])
    of_kind = lambda k: F.filter(base, lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", lambda x: ~x["seed"])).cast("long").alias("n_discovered"))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span of its text replaced by the kind in brackets; n_chars, where there is one, counts the new text."""
    text = F.col("kept.text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    piece = lambda at, end: F.substring(text, at.cast("int") + 1, (end - at).cast("int"))

    def step(acc, x):
        more = F.concat(acc["out"], piece(acc["at"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        inside = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))  # what a span before covers too
        return F.when(x["start"] >= acc["at"], F.struct(more.alias("out"), x["end"].alias("at"))).otherwise(inside)

    cut = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], piece(acc["at"], F.length(text).cast("long"))))
    found = _extract(docs, docs.columns).select("kept", F.when(F.size("spans") > 0, cut).otherwise(text).alias("redacted"))
    instead = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return found.select(*[instead.get(c, F.col(f"kept.`{c}`")).alias(c) for c in docs.columns])
