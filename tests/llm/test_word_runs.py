"""Runs of words against plain comparing."""

import hashlib
import random
import zlib

from prismlake.llm import queries, word_runs


def plain(w):
    """Every stretch whose words q apart are identical; of equal stretches the smallest period."""
    best = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(24, 3 * q):
                best.setdefault((s, i - s + q), q)
    return sorted((s, n, q) for (s, n), q in best.items())


def some_words(rng):
    k, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 1, 5, 23, 24, 30, 80, 200])
    w = [b"%d" % rng.randrange(k) for _ in range(n)]
    for _ in range(rng.choice([0, 1, 2, 3])):
        a = [b"%d" % rng.randrange(k) for _ in range(rng.randint(1, 40))]
        at = rng.randint(0, len(w))
        w[at:at] = (a * rng.randint(2, 7))[: rng.randint(1, 150)]
    return w


def test_equal_to_plain_comparing():
    rng, n = random.Random(1), 0
    for _ in range(400):
        texts = [some_words(rng) for _ in range(rng.randint(1, 5))]
        got = word_runs.runs_of(texts)
        assert got == [plain(w) for w in texts]
        n += sum(map(len, got))
    assert n > 500


def test_words_of_a_few_letters_exactly():
    """Every string of two words of some length, repeated, so that runs of all small periods meet."""
    for k in range(1 << 9):
        w = [b"%d" % (k >> b & 1) for b in range(9)] * 4
        assert word_runs.runs_of([w]) == [plain(w)]


def test_fibonacci_words():
    """As many runs as a text can have."""
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 700:
        a, b = b, b + a
    assert word_runs.runs_of([b, b * 3]) == [plain(b), plain(b * 3)]


def test_long_texts_take_steps_in_proportion():
    """A million equal words, and a period of thousands."""
    assert word_runs.runs_of([[b"x"] * 300_000]) == [[(0, 300_000, 1)]]
    period = [b"%d" % k for k in range(5000)]
    assert word_runs.runs_of([[b"a", *period * 4, b"b"]]) == [[(1, 20_000, 5000)]]


def test_collapsed(written):
    line = "please read the terms of use of this page before you go on"
    docs = written([(1, f"Start  here. {line} {line}\n{line} {line} end."), (2, None), (3, ""), (4, "no  runs\there"), (None, "y " * 30), (4, " \n ")])
    got = sorted(tuple(r)[1:] for r in word_runs.collapse(docs).collect() if r["doc_id"] in (1, None))
    assert got == [(1, f"Start here. {line} end."), (1, "y")]
    assert {(r["n_runs"], r["text"]) for r in word_runs.collapse(docs).collect() if r["doc_id"] in (2, 3, 4)} == {(0, None), (0, ""), (0, "no  runs\there"), (0, " \n ")}
    runs = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in word_runs.find(docs).collect()}
    assert runs[1] == [(2, 52, 13)] and runs[None] == [(0, 30, 1)] and runs[2] == []


def test_digests_of_defined_cases(written):
    edited = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(edited, " ".join(f"w{k}" for k in range(400))), (1, None), (2, "one"), (None, "a b " * 20 + "c " * 30), (2, "one"), (edited, None)]
    got = {(r["doc_id"], r["collapsed_sha256"]): r for r in word_runs.digests(written(rows)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    tie = got[None, sha("a b c")]
    assert (tie["n_runs"], tie["start"], tie["length"], tie["period"], tie["exponent_milli"]) == (2, 40, 30, 1, 30000) and tie["runs_sha256"] == sha("0,40,2\n40,30,1\n")
    assert got[1, sha("")]["n_runs"] == 0 and got[2, sha("one")]["start"] is None and got[edited, sha("")]["runs_sha256"] == sha("")
    g = zlib.crc32(str(edited).encode()) // 10
    a = g % 400
    p = 1 + (400 - a) // (3 + g % 8)
    w = [f"w{k if k < a else a + (k - a) % p}" for k in range(400)]
    runs = plain([x.encode() for x in w])
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
    assert got[edited, sha(" ".join(kept))]["n_runs"] == len(runs)


def test_ties_of_exponents(written):
    """The smaller start wins."""
    r = word_runs.digests(written([(None, "a " * 30 + "b " * 30)])).first()
    assert (r["n_runs"], r["start"], r["period"]) == (2, 0, 1)


def test_whole_table(spark, duck, sf_dir):
    got = {r["doc_id"]: r for r in queries.op12_word_runs(spark, sf_dir).collect()}
    found = 0
    for d, text in duck.execute("select doc_id, text from documents").fetchall():
        runs = plain(word_runs.edited((text or "").encode().split(), d))
        assert got[d]["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        found += len(runs)
    assert found > 10
