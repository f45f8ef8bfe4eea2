"""Language model scoring by a probabilistic suffix tree over words.

A text's tokens are its words (runs without white space, A-Z lower-cased) and one end. A state of the tree is a context:
the last one to DEPTH words before a token, whatever stands between them; the empty context is the root. A document's
first tokens have the shorter contexts that there are.

A context's distribution is smoothed by the shorter context's (without its first word) with the weight of the number d of
distinct tokens that follow it: (n + d * shorter) / (all + d). At the root, the shorter distribution is a word's
spelling, byte by byte after the byte before it, so any word has a probability.

A context is retained if its divergence test passes: over the tokens that follow it in training, the logarithm of how much
more likely each is by what follows the context elsewhere (itself left out) than by what follows the shorter context
elsewhere adds up to DIVERGENCE at least. The sum is the number of occurrences times a divergence that is not biased
upward by what was seen once, so the bound is one of evidence and the tree grows with the corpus. Contexts that a retained
one ends with are retained too. A token is scored from the longest retained context before it.

How it is spread: a task's documents form blocks of MOST_TOKENS. A block sends its distinct words, then its distinct
contexts and continuations, each once with its count, to buckets: words by their hash, contexts by the word next to the
token, so that a context and all it ends with meet in one bucket. A word that takes up more than a bucket is split by the
word before it; what follows the word alone goes to each of its parts. Buckets count, test, and answer each block what it
asked, and blocks are scored from the answers. No task holds more than a bucket or a block, and no states are broadcast;
buckets get the counts of those words that make up FREQUENT of all tokens (so at most 1 / FREQUENT words), and use
FREQUENT as the count of the others in the test of one-word contexts, which makes it stricter, never laxer. What is held for
each position of a block are numbers of 32 bits, and nothing of a block that is done stays while the next one is read.

Words are known by 64-bit hashes. Next to a known word, a frequent one is named by its place in the list of the frequent words
(the most frequent first), any other by 63 bits of its hash.

The score of a text is the log10 of a probability over all token sequences.

Defined cases: a null or empty text has one token, the end; without training documents counts are 0, the base score is
log10(1 / (N + V + 1)) for N = V = 0, and every byte is even; repeated rows count each; a null id trains as any other
that the split leaves to training; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import join, pack, parts_of, unpack
from .common import drop, materialize, text_bytes
from .shingles import hash_words, mix, split_words

DEPTH, DIVERGENCE = 2, 5.0
MOST_TOKENS, TOKENS_A_BUCKET, BYTES_A_BUCKET = 1_000_000, 500_000, 4 << 20
#: Occurrences of a word in each part of it.
TOKENS_A_PART = 2 * TOKENS_A_BUCKET
FREQUENT = 1e-6
END = np.uint64(0x243F6A8885A308D3)
#: Positions of a block that are scored at a time.
POSITIONS = 1 << 17
#: The byte before a word, and after it.
EDGE = 32
#: The bucket of rows that are no answers: after all others.
DOCUMENTS = (1 << 31) - 1
#: Set in the codes of words that are not frequent.
_RARE = np.uint64(1 << 63)


@dataclass
class Words:
    """The counts of frequent words, by sorted hashes, and of all training tokens and distinct words.

    A frequent word's code is its place by count, any other's its hash with the bit _RARE.
    """

    hashes: np.ndarray
    counts: np.ndarray
    n: int
    v: int

    def __post_init__(self):
        order = np.lexsort((self.hashes, -self.counts))
        self.by_code = self.counts[order]
        self.codes = np.empty(len(order), dtype=np.uint64)
        self.codes[order] = np.arange(len(order), dtype=np.uint64)

    def _find(self, wanted: np.ndarray, values: np.ndarray, other) -> np.ndarray:
        if not len(self.hashes):
            return np.broadcast_to(other, wanted.shape).copy()
        at = np.searchsorted(self.hashes, wanted)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == wanted, values[at], other)

    def count(self, wanted: np.ndarray) -> np.ndarray:
        """How often words occur, 0 for those that are not frequent."""
        return self._find(wanted, self.counts, 0.0)

    def code(self, wanted: np.ndarray) -> np.ndarray:
        return self._find(wanted, self.codes, wanted | _RARE)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets rise with hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _groups(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each place which of the sorted groups it is in; `order`: places as sorted, `new`: where groups begin."""
    number = np.cumsum(new, dtype=np.uint32)
    number -= np.uint32(1)
    at = np.empty(len(order), dtype=np.uint32)
    at[order] = number
    return at


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with its inverse, of 64-bit numbers: their places stand in their lowest bits, so that numbers are sorted and no index."""
    mask = np.uint64((1 << len(hashes).bit_length()) - 1)
    keys = hashes & ~mask
    keys |= np.arange(len(hashes), dtype=np.uint32)
    keys.sort()
    keys &= mask
    order = keys.astype(np.uint32)
    del keys
    rising = hashes[order]
    if (rising[1:] < rising[:-1]).any():  # some differ in these bits alone
        return np.unique(hashes, return_inverse=True)
    new = np.ones(len(rising), dtype=bool)
    new[1:] = rising[1:] != rising[:-1]
    rising = rising[new]
    return rising, _groups(order, new)


def _distinct_pairs(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of numbers under 2**32 in order, their halves apart, and for each of the given ones which it is."""
    n = len(high)
    most = lambda x: int(x.max()).bit_length() if n else 0
    place, lower = n.bit_length(), most(low)
    if place + lower + most(high) > 64:
        keys, at = np.unique((high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64), return_inverse=True)
        return (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32), at
    keys = high.astype(np.uint64)
    keys <<= np.uint64(lower)
    keys |= low.astype(np.uint32)
    keys <<= np.uint64(place)
    keys |= np.arange(n, dtype=np.uint32)
    keys.sort()
    order = (keys & np.uint64((1 << place) - 1)).astype(np.uint32)
    keys >>= np.uint64(place)
    new = np.ones(n, dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    at = _groups(order, new)
    return (keys >> np.uint64(lower)).astype(np.uint32), (keys & np.uint64((1 << lower) - 1)).astype(np.uint32), at


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start as many as its size."""
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    return np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))


def _firsts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _pack_rising(values: np.ndarray) -> bytes:
    """Sorted numbers of 64 bits as differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_rising(payload: bytes) -> np.ndarray:
    return np.cumsum(unpack(payload, "<u8"), dtype=np.uint64)


def _steps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rising values of groups as differences, each group's first as it is."""
    out = values.astype(np.int64)
    out[1:] -= values[:-1].astype(np.int64)
    first = _firsts(sizes)[:-1][sizes > 0]
    out[first] = values[first]
    return out


def _sums(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values that _steps() has made differences of."""
    out = np.cumsum(steps)
    first = _firsts(sizes)[:-1][sizes > 0]
    return out - np.repeat(out[first] - steps[first], sizes[sizes > 0])


def _pack_codes(codes: np.ndarray, sizes: np.ndarray) -> bytes:
    """Rising codes of groups: how many of each group are rare, then places as differences, then the rare ones' hashes."""
    rare = codes >= _RARE
    so_far, cuts = _firsts(rare), _firsts(sizes)
    of_group = so_far[cuts[1:]] - so_far[cuts[:-1]]
    return join([pack(of_group.astype("<u4")), pack(_steps(codes[~rare], sizes - of_group).astype("<u4")), pack(codes[rare])])


def _unpack_codes(payload: bytes, sizes: np.ndarray) -> np.ndarray:
    of_group, places, rare = (unpack(p, t) for p, t in zip(parts_of(payload), ("<u4", "<u4", "<u8"), strict=True))
    of_group = of_group.astype(np.int64)
    out, last = np.empty(int(sizes.sum()), dtype=np.uint64), np.zeros(int(sizes.sum()), dtype=bool)
    last[_ranges(_firsts(sizes)[1:] - of_group, of_group)] = True
    out[last], out[~last] = rare, _sums(places.astype(np.int64), sizes - of_group).astype(np.uint64)
    return out


class Block:
    """Documents of one task, until they have MOST_TOKENS."""

    def __init__(self, task: int, number: int):
        self.task, self.number = task, number
        self.ids: list[int | None] = []
        self.hashes: list[np.ndarray] = []
        self.spelt: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, data: bytes, spelling: np.ndarray | None) -> np.ndarray:
        """Takes a document in; gives its bytes, lower-cased and with one edge at either end."""
        codes, starts, ends = split_words(data)
        words = np.concatenate([hash_words(codes, starts, ends), [END]])
        self.ids.append(doc_id)
        self.hashes.append(words)
        self.size += len(words)
        around = np.full(len(codes) + 2, EDGE, dtype=np.uint8)
        around[1:-1] = codes
        if spelling is not None:
            steps = np.concatenate([[0.0], np.cumsum(spelling[around[:-1], around[1:]])])
            self.spelt.append(np.concatenate([steps[ends + 1] - steps[starts], [spelling[EDGE, EDGE]]]).astype(np.float32))
        return around

    def seal(self) -> None:
        self.sizes = np.array([len(h) for h in self.hashes], dtype=np.int64)
        self.tokens = np.concatenate(self.hashes)
        self.hashes.clear()
        self.words, self.at = _distinct(self.tokens)
        # another scan of other documents has other blocks, whose answers are then missing
        self.key = xxhash.xxh3_64_intdigest(self.words.tobytes() + self.sizes.tobytes(), seed=(self.task << 16) + self.number) >> 1


def read_blocks(batches, spelling: np.ndarray | None = None, seen=None):
    """Blocks of rows (doc_id, text, task). `seen` is told each document's id and bytes."""
    block, number = None, 0
    for batch in batches:
        for doc_id, text, task in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            block = block or Block(task, number)
            around = block.add(doc_id, (text or "").encode("utf-8", "surrogatepass"), spelling)
            if seen:
                seen(doc_id, around)
            if block.size >= MOST_TOKENS:
                block.seal()
                yield block
                block, number = None, number + 1
    if block:
        block.seal()
        yield block


@dataclass
class Level:
    """Contexts of a length and what follows them: for each parent (a context shorter by a word) how many there are, what they add to it, for each how many tokens follow, and of these which of the parent's they are and how often they occur in training."""

    children: np.ndarray
    names: np.ndarray
    follows: np.ndarray
    which: np.ndarray
    counts: np.ndarray


@dataclass
class Contexts:
    """A block's contexts by level, in the order of buckets; and of each position, by level, the context and the token after it, -1 where there is none."""

    levels: list[Level]
    context: list[np.ndarray]
    token: list[np.ndarray]
    buckets: np.ndarray


def contexts(tokens: np.ndarray, sizes: np.ndarray, trains: np.ndarray, frequent: Words, buckets: int, depth: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> Contexts:
    """The contexts of documents that follow each other in `tokens`; `trains` says which documents count; `known`: the distinct words, rising, and each token's place among them, if they are known."""
    n = len(tokens)
    place = np.arange(n, dtype=np.uint32)
    place -= np.repeat(_firsts(sizes)[:-1].astype(np.uint32), sizes)
    weight = np.repeat(trains.astype(bool), sizes)
    at = np.flatnonzero(place >= 1).astype(np.uint32)
    # words as numbers that rise with their codes
    words, local = _distinct(tokens) if known is None else known
    codes = frequent.code(words)
    by_code = np.argsort(codes)
    rank = np.empty(len(words), dtype=np.uint32)
    rank[by_code] = np.arange(len(words), dtype=np.uint32)
    last, local, codes = local[at - 1], rank[local], codes[by_code]
    is_last = np.bincount(last, minlength=len(words)) > 0
    v, of_v = words[is_last], (np.cumsum(is_last) - 1).astype(np.uint32)[last]
    del last
    parts = np.maximum(1, frequent.count(v) // TOKENS_A_PART).astype(np.int64)
    # a word of several parts is as many contexts
    names = mix(np.repeat(v, parts) + _ranges(np.zeros(len(v), np.int64), parts).astype(np.uint64))
    bucket = bucket_of(names, buckets)
    order = np.argsort(names)  # and so by buckets
    rank = np.empty(len(order), dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    here = _firsts(parts)[:-1].astype(np.uint32)[of_v]
    split = np.flatnonzero((parts > 1)[of_v] & (place[at] >= 2))
    here[split] += (mix(tokens[at[split] - 2]) % parts[of_v[split]].astype(np.uint64)).astype(np.uint32)
    here = rank[here]

    of_key, key_token, which = _distinct_pairs(of_v, local[at])
    counts = np.bincount(which, weights=weight[at], minlength=len(of_key)).astype(np.uint32)
    follows = np.bincount(of_key, minlength=len(v))
    first = _firsts(follows)[:-1]
    which -= first.astype(np.uint32)[of_v]
    del of_v
    v_of = np.repeat(np.arange(len(v)), parts)[order]
    whole = _ranges(first[v_of], follows[v_of])
    level = Level(np.ones(1, np.int64) * len(order), names[order], follows[v_of], codes[key_token][whole], counts[whole])
    del whole, counts, of_key, key_token
    levels, context, tokens_of = [level], [_spread(n, at, here)], [_spread(n, at, _firsts(level.follows)[:-1].astype(np.uint32)[here] + which)]
    owner = bucket[order]
    for k in range(2, depth + 1):
        deep = place[at] >= k
        at = at[deep]
        here = here[deep]
        which = which[deep]
        parents = len(levels[-1].names)
        of_context, word, here = _distinct_pairs(here, local[at - k])
        context.append(_spread(n, at, here))
        children = np.bincount(of_context, minlength=parents)
        of_gram, gram, which = _distinct_pairs(here, which)
        tokens_of.append(_spread(n, at, which))
        follows = np.bincount(of_gram, minlength=len(of_context))
        levels.append(Level(children, codes[word], follows, gram, np.bincount(which, weights=weight[at], minlength=len(gram)).astype(np.uint32)))
        which -= _firsts(follows)[:-1].astype(np.uint32)[here]
    return Contexts(levels, context, tokens_of, owner)


def _spread(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """`values` at their places of n, -1 elsewhere."""
    out = np.full(n, -1, dtype=np.int32)
    out[at] = values
    return out


def questions(c: Contexts):
    """bucket, payload: what each bucket is asked, its contexts and what follows them by level."""
    cuts = np.flatnonzero(np.diff(np.concatenate([[-1], c.buckets, [-1]])))
    edges, ends = [_firsts(x.children) for x in c.levels], [_firsts(x.follows) for x in c.levels]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        bucket, parts = int(c.buckets[a]), []
        for k, level in enumerate(c.levels):
            if k:
                children = level.children[a:b]
                a, b = int(edges[k][a]), int(edges[k][b])
                parts += [pack(children.astype("<u4")), _pack_codes(level.names[a:b], children)]
            else:
                parts.append(_pack_rising(level.names[a:b]))
            c0, c1 = int(ends[k][a]), int(ends[k][b])
            follows, which = level.follows[a:b], level.which[c0:c1]
            parts += [pack(follows.astype("<u4")), pack(_steps(which, follows).astype("<u4")) if k else _pack_codes(which, follows), pack(level.counts[c0:c1].astype("<u4"))]
        yield bucket, join(parts)


def _read_question(payload: bytes, depth: int) -> list[Level]:
    parts, out = iter(parts_of(payload)), []
    for k in range(depth):
        number = lambda: unpack(next(parts), "<u4")
        children = number() if k else None
        names = _unpack_codes(next(parts), children) if k else _unpack_rising(next(parts))
        follows = number()
        which = _sums(number().astype(np.int64), follows).astype(np.uint32) if k else _unpack_codes(next(parts), follows)
        out.append(Level(children, names, follows, which, number()))
    return out


def _number_rare(asked: list[list[Level]], first: int) -> None:
    """Replace, in what a bucket is asked, the codes of rare words by numbers from `first`, so that codes have 32 bits."""
    lists = [(q[0], "which") for q in asked] + [(level, "names") for q in asked for level in q[1:]]
    numbers = _distinct(np.concatenate([x[x >= _RARE] for x in (getattr(*of) for of in lists)]))[1]
    at = 0
    for of in lists:
        x = getattr(*of)
        r = x >= _RARE
        k = int(r.sum())
        short = x.astype(np.uint32)
        short[r] = numbers[at : at + k] + np.uint32(first)
        setattr(*of, short)
        at += k


def answers(payloads: list[bytes], frequent: Words, depth: int = DEPTH, divergence: float = DIVERGENCE) -> list[bytes]:
    """What a bucket says to each of those that ask it: by level, for each context how many tokens follow it in training and how many distinct ones (0 if it is not retained), and for each token after a retained context how often it follows."""
    asked = [_read_question(p, depth) for p in payloads]
    often = len(frequent.by_code)
    _number_rare(asked, often)
    seen = np.append(frequent.by_code, FREQUENT * frequent.n)
    context: list[list[np.ndarray]] = []  # by level, and for each that asks, the contexts' numbers in the bucket
    gram: list[list[np.ndarray]] = []
    alls, distincts, ns, tests, parents, loo = [], [], [], [], [], []
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(depth):
            if k == 0:
                own, at = _distinct(np.concatenate([q[0].names for q in asked]))
            else:
                own, _, at = _distinct_pairs(np.concatenate([np.repeat(context[-1][i], q[k].children) for i, q in enumerate(asked)]), np.concatenate([q[k].names for q in asked]))
            context.append(np.split(at, np.cumsum([len(q[k].names) for q in asked])[:-1]))
            sub = []
            for i, q in enumerate(asked):
                if k == 0:
                    sub.append(q[0].which)
                else:
                    # a token is named by its place among those of the parent
                    first = _firsts(q[k - 1].follows)[:-1]
                    parent = np.repeat(np.repeat(np.arange(len(q[k].children)), q[k].children), q[k].follows)
                    sub.append(gram[-1][i][first[parent] + q[k].which])
            of, below, at = _distinct_pairs(np.concatenate([np.repeat(context[k][i], q[k].follows) for i, q in enumerate(asked)]), np.concatenate(sub))
            gram.append(np.split(at, np.cumsum([len(q[k].which) for q in asked])[:-1]))
            n = np.bincount(at, weights=np.concatenate([q[k].counts for q in asked]), minlength=len(of))
            every = np.bincount(of, weights=n, minlength=len(own))
            distinct = np.bincount(of, weights=n > 0, minlength=len(own))
            if k == 0:
                c = seen[np.minimum(below, np.uint32(often))]
                shorter = np.maximum(c - 1, 0.5) / max(1, frequent.n + frequent.v)
            else:
                shorter = loo[-1][below]
            d = distinct[of] - (n == 1)
            left = (n - 1 + d * shorter) / (every[of] - 1 + d)
            left = np.where((n > 0) & (every[of] - 1 + d > 0), left, shorter)
            test = np.bincount(of, weights=np.where(n > 0, n * np.log(left / shorter), 0.0), minlength=len(own))
            alls.append(every)
            distincts.append(distinct)
            ns.append(n)
            loo.append(left)
            tests.append(test >= divergence)
            parents.append(own if k else None)
    for k in range(depth - 1, 0, -1):
        tests[k - 1][parents[k][tests[k]]] = True
    out = []
    for i, q in enumerate(asked):
        parts = []
        for k in range(depth):
            keep = tests[k][context[k][i]]
            parts += [pack(np.where(keep, x[k][context[k][i]], 0).astype("<u4")) for x in (alls, distincts)]
            parts.append(pack(np.where(np.repeat(keep, q[k].follows), ns[k][gram[k][i]], 0).astype("<u4")))
        out.append(join(parts))
    return out


def read_answers(payloads: list[bytes], depth: int) -> list[list[np.ndarray]]:
    """By level: all, distinct and n of the contexts and tokens of a block, from the answers of its buckets in their order."""
    every = [[unpack(p, "<u4") for p in parts_of(x)] for x in payloads]
    return [[np.concatenate([e[3 * k + j] for e in every]) if every else np.zeros(0, np.uint32) for j in range(3)] for k in range(depth)]


def log_scores(c: Contexts, root: np.ndarray, found: list[list[np.ndarray]]) -> np.ndarray:
    """log10 probability of every token from its longest retained context; `root`: its probability after the empty one."""
    p = root.copy()
    for a in range(0, len(p), POSITIONS):
        here = slice(a, a + POSITIONS)
        part = p[here]
        for context, token, (every, distinct, n) in zip(c.context, c.token, found, strict=True):
            has = np.flatnonzero(context[here] >= 0)
            has = has[every[context[here][has]] > 0]
            at = context[here][has]
            part[has] = (n[token[here][has]] + distinct[at] * part[has]) / (every[at].astype(np.float64) + distinct[at])
    return np.log10(p, out=p)


def spelling_table(pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each byte after each, from how often they follow each other in words; the closing edge is a byte."""
    n = pairs.reshape(256, 256).astype(np.float64)
    n[EDGE, EDGE] = 0
    n += 0.01
    return np.log10(n / n.sum(axis=1, keepdims=True))


def _row(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=names)


_NAMES, _KINDS = ["block", "bucket", "payload", "tokens", "trained"], [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
_SCHEMA = "block long, bucket int, payload binary, tokens long, trained long"


def _sorted_groups(batches):
    """bucket and rows of each bucket, from rows (block, bucket, payload, ...) in the order of buckets."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[1] != held[0][1]:
                yield held[0][1], held
                held = []
            held.append(row)
    if held:
        yield held[0][1], held


def _by(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(keys[0]).sortWithinPartitions(*keys)


def score(docs: DataFrame, train: tuple[int, int], depth: int = DEPTH, divergence: float = DIVERGENCE) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of `docs` (doc_id, text), a scan of files.

    The model learns from documents whose crc32(id as text) mod train[1] is not train[0].
    """
    spark = docs.sparkSession
    rest, mod = train
    trains = lambda d: d is None or zlib.crc32(str(d).encode()) % mod != rest
    scan = docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id())
    buckets = max(8, text_bytes(docs) // BYTES_A_BUCKET)

    def count_words(batches):
        """Rows of a block's distinct words with their counts in training, by bucket; at the end how often bytes follow each other."""
        pairs = np.zeros(1 << 16, dtype=np.int64)
        task = None

        def seen(doc_id, around):
            nonlocal pairs
            if trains(doc_id):
                pairs += np.bincount(around[:-1].astype(np.int64) * 256 + around[1:], minlength=1 << 16)

        for block in read_blocks(batches, seen=seen):
            task = block.task
            weight = np.repeat([trains(d) for d in block.ids], block.sizes).astype(np.float64)
            counts = np.bincount(block.at, weights=weight, minlength=len(block.words)).astype("<u8")
            bucket = bucket_of(block.words, buckets)
            cuts = np.flatnonzero(np.diff(np.concatenate([[-1], bucket, [-1]])))
            rows = [(block.key, int(bucket[a]), join([_pack_rising(block.words[a:b]), pack(counts[a:b])]), None, None) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            for at in range(0, len(rows), 256):
                yield _row(_NAMES, _KINDS, rows[at : at + 256])
            yield _row(_NAMES, _KINDS, [(block.key, -1, None, block.size, int(weight.sum()))])
            del block, weight, counts, bucket, rows  # not beside the next block
        if task is not None:
            yield _row(_NAMES, _KINDS, [(task, -2, pack(pairs), None, None)])

    asked = materialize(scan.mapInArrow(count_words, _SCHEMA), "words")
    sums = asked.filter("bucket = -1").agg(F.sum("tokens").alias("t"), F.sum("trained").alias("n")).first()
    tokens, n = sums["t"] or 0, sums["n"] or 0

    def unfold(batches):
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                pairs = unpack(payload, "<i8")
                at = np.flatnonzero(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pairs[at])], names=["pair", "n"])

    pairs = np.zeros(1 << 16)
    for r in asked.filter("bucket = -2").select("payload").mapInArrow(unfold, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    spelling = spelling_table(pairs)

    def sum_words(batches):
        """To each block the counts of its words; and what a bucket has: distinct words, and the frequent ones."""
        for bucket, rows in _sorted_groups(batches):
            parts = [parts_of(r[2]) for r in rows]
            words = [_unpack_rising(p[0]) for p in parts]
            known, at = _distinct(np.concatenate(words))
            counts = np.bincount(at, weights=np.concatenate([unpack(p[1], "<u8") for p in parts]).astype(np.float64)).astype("<u8")
            for row, mine in zip(rows, np.split(at, np.cumsum([len(w) for w in words])[:-1]), strict=True):
                yield _row(_NAMES, _KINDS, [(row[0], bucket, pack(counts[mine]), None, None)])
            often = (counts > 0) & (counts >= FREQUENT * n)
            yield _row(_NAMES, _KINDS, [(bucket, -1, join([pack(known[often]), pack(counts[often])]), None, int((counts > 0).sum()))])

    counted = materialize(_by(asked.filter("bucket >= 0"), "bucket").mapInArrow(sum_words, _SCHEMA), "counts")
    drop(asked)
    v = counted.filter("bucket = -1").agg(F.sum("trained").alias("v")).first()["v"] or 0
    # bounded: at most 1 / FREQUENT words
    often = [parts_of(r["payload"]) for r in counted.filter("bucket = -1").select("payload").toLocalIterator()]
    hashes = np.concatenate([unpack(p[0], "<u8") for p in often] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([unpack(p[1], "<u8") for p in often] or [np.zeros(0, np.uint64)])
    order = np.argsort(hashes)
    shared = spark.sparkContext.broadcast(Words(hashes[order], counts[order].astype(np.float64), n, v))
    context_buckets = max(8, tokens // TOKENS_A_BUCKET)

    def ask(batches):
        for block in read_blocks(batches):
            weights = np.array([trains(d) for d in block.ids])
            rows = [(block.key, bucket, payload, None, None) for bucket, payload in questions(contexts(block.tokens, block.sizes, weights, shared.value, context_buckets, depth, (block.words, block.at)))]
            del block, weights  # not beside the next one
            for at in range(0, len(rows), 64):
                yield _row(_NAMES, _KINDS, rows[at : at + 64])
            del rows

    def reply(batches):
        for bucket, rows in _sorted_groups(batches):
            # numbered after the answers about words
            for row, payload in zip(rows, answers([r[2] for r in rows], shared.value, depth, divergence), strict=True):
                yield _row(_NAMES, _KINDS, [(row[0], buckets + bucket, payload, None, None)])

    told = _by(scan.mapInArrow(ask, _SCHEMA), "bucket").mapInArrow(reply, _SCHEMA)

    def sequences(batches):
        """Each block's documents as one row."""
        for block in read_blocks(batches, spelling):
            first = np.full(len(block.words), -1.0, dtype=np.float32)
            first[block.at] = np.concatenate(block.spelt)
            ids = np.array([0 if d is None else d for d in block.ids], dtype="<i8")
            parts = [ids, np.array([d is not None for d in block.ids], dtype="u1"), block.sizes.astype("<u4"), first.astype("<f4"), block.at.astype("<u4")]
            yield _row(_NAMES, _KINDS, [(block.key, DOCUMENTS, join([_pack_rising(block.words), *map(pack, parts)]), None, None)])
            del block, first, parts  # not beside the next block

    def scored(key, rows):
        """A block's documents with their scores; takes `rows` away as they are read."""
        if rows[-1][1] != DOCUMENTS:
            raise RuntimeError(f"block {key} has no documents: the scan has changed")
        parts = parts_of(rows[-1][2])
        c = np.concatenate([unpack(r[2], "<u8") for r in rows if r[1] < buckets] or [np.zeros(0, np.uint64)]).astype(np.float64)
        got = read_answers([r[2] for r in rows if buckets <= r[1] < DOCUMENTS], depth)
        rows.clear()
        words = _unpack_rising(parts[0])
        ids, has_id, sizes, spelt, at = (unpack(p, t) for p, t in zip(parts[1:], ("<i8", "u1", "<u4", "<f4", "<u4"), strict=True))
        if len(c) != len(words):
            raise RuntimeError(f"block {key} asked for {len(words)} words and has {len(c)}")
        sizes = sizes.astype(np.int64)
        found = contexts(words[at], sizes, np.zeros(len(sizes)), shared.value, context_buckets, depth, (words, at))
        if any(len(g[0]) != len(x.names) or len(g[2]) != len(x.which) for g, x in zip(got, found.levels, strict=True)):
            raise RuntimeError(f"answers about the contexts of block {key} are missing")
        spread = max(v, 1)
        root = (c + spread * 10 ** spelt.astype(np.float64)) / (n + spread)
        edge = _firsts(sizes)[:-1]
        scores = np.add.reduceat(log_scores(found, root[at], got), edge)
        del found, got
        base = np.log10((c + 1) / (n + v + 1))
        columns = [ids, sizes, np.add.reduceat((c > 0)[at].astype(np.int64), edge), np.full(len(ids), n, np.int64), np.add.reduceat(base[at], edge), scores]
        arrays = [pa.array(ids, pa.int64(), mask=has_id == 0), *(pa.array(x) for x in columns[1:])]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def assemble(batches):
        for key, rows in _blocks(batches):
            yield scored(key, rows)

    rows = counted.filter("bucket >= 0").unionByName(told).unionByName(scan.mapInArrow(sequences, _SCHEMA))
    return _by(rows, "block", "bucket").mapInArrow(assemble, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _blocks(batches):
    """key and rows of each block, from rows in the order of blocks and buckets."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != held[0][0]:
                yield held[0][0], held
                held = []
            held.append(row)
    if held:
        yield held[0][0], held
