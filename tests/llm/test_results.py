"""Results against brute force, exact round trips, libraries and held-out accuracy."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from samples import prose
from tokenizers import Tokenizer, models, pre_tokenizers

import corpus_pipeline
from prismlake.llm import ann, bpe, blocks, common, components, langid, minhash_forest, mixing, oracles, pii, queries, sharding, shingles, spotsigs, suffix_tree, unigram_counts

LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return common.documents(spark, sf_dir)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def words(text):
    return re.findall(r"[^ \t-\r]+", (text or "").translate(LOWER))


def test_written_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "_written", {})
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    df = common.materialize(spark.range(5), "five")
    assert df.count() == 5 and [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["five"]
    common.clear(spark)
    assert list(tmp_path.iterdir()) == []


# language


def test_language_of_held_out_documents(spark, docs, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = queries.op1_language_id(spark, sf_dir).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_sees_the_text_only(docs):
    renamed = docs.withColumns({"doc_id": F.col("doc_id") + 1_000_000, "lang": F.lit("xx"), "source": F.lit("y")})
    model = langid.fit(docs)
    predict = langid.predictor(docs.sparkSession, model)
    a = [r[0] for r in docs.orderBy("doc_id").select(predict(F.col("text")).alias("p")).collect()]
    b = [r[0] for r in renamed.orderBy("doc_id").select(predict(F.col("text")).alias("p")).collect()]
    assert a == b


def test_language_rejects_what_is_none(docs):
    model = langid.fit(docs)
    assert model.predict("1234 !!! ???")[0] == "und" and model.predict("1234")[2]
    assert not model.predict("the of and to in that is was for with on as by at from")[2]
    junk = langid.random_texts(np.random.default_rng(24), 200)
    assert sum(model.predict(t)[2] for t in junk) >= 0.9 * len(junk)
    clean = [r["text"] for r in docs.select("text").collect() if re.search(r"[^\W\d_]", r["text"] or "")]
    assert sum(model.predict(t)[2] for t in clean) <= 0.01 * len(clean)


# shards


def test_shards(written):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(2000)] + [(i, "one text that a third shares") for i in range(2000, 3000)] + [(i, "a pair") for i in (5000, 5001)] + [(5002, None)]
    got = sharding.shard(written(rows), 24).collect()
    text = dict(rows)
    size = {i: len((t or "").encode()) + 8 for i, t in rows}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (size[i], zlib.crc32((t or "").encode())) for i, t in rows}
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) == set(range(24)) and all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    sums = [sum(r["size"] for r in v) for v in by.values()]
    even = sum(size.values()) / 24
    assert max(abs(s - even) for s in sums) <= max(size.values()) + 0.02 * even
    assert len({r["shard"] for r in got if text[r["doc_id"]] == "a pair"}) == 1
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)


def test_shards_of_short_texts_that_many_share(written, duck):
    """A group may be small in bytes, so that it moves as one, and large in rows, so that it spans several cells."""
    for seed in range(3):
        rng = random.Random(seed)
        rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(1907)] + [(5000 + i, None) for i in range(120)] + [(6000 + i, "ab") for i in range(90 * seed)]
        docs = written(rows, name=f"short{seed}")
        got = sharding.shard(docs, 24).toPandas()
        for _, part in got.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))
        duck.register("documents_short", docs.toPandas())
        sql = oracles.sharding(24).replace("from documents)", "from documents_short)")
        want = duck.execute(sql).df()
        key = ["doc_id", "size", "text_crc32", "shard", "slot"]
        assert sorted(map(tuple, got[key].to_numpy().tolist())) == sorted(map(tuple, want[key].to_numpy().tolist()))


def test_shards_of_one_document(written):
    assert [tuple(r)[4:6] for r in sharding.shard(written([(1, "x")]), 24).collect()] == [(12, 0)]


# byte-level BPE


def reference_encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def test_bpe_is_the_librarys(spark, sf_dir, texts):
    library = reference_encoding()
    for r in queries.op3_byte_bpe(spark, sf_dir).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_ascii_texts_are_split_in_the_same_way():
    split, general = bpe.splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN)
    assert bpe.ascii_pattern(public_tokenizers.PATTERN) and bpe.ascii_pattern(r"\p{Lu}+") is None and bpe.ascii_pattern(r"(?i)a") is None
    rng = random.Random(25)
    texts = [chr(a) + chr(b) + c for a in range(128) for b in range(128) for c in ("", "a", " ")]
    texts += ["".join(rng.choice(" \n\t\x0b\x1c\x00ab9'.sS_") for _ in range(20)) for _ in range(3000)]
    assert all(split(t) == general.findall(t) for t in texts)


def test_bpe_of_odd_texts_in_small_blocks(written, monkeypatch):
    monkeypatch.setattr(blocks, "MOST_TOKENS", 50)
    odd = ["<|endoftext|> is text", "  two  blanks\n\n", "é" * 200, "x" * 5000, "🙂" * 40, "1234567890 a's we'll", "", None, "漢字 текст", " ", "a" * 47, "ab" * 24, "zq" * 24 + "x"]
    library, ranks = reference_encoding(), bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(written(list(enumerate(odd))), ranks, public_tokenizers.PATTERN).collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(odd)}


# fingerprints


def plain_signatures(text):
    found = [w for w in re.sub(r"[\W_]+", " ", text.lower()).strip().split(" ") if w]
    chains, out = ["^", *found], set()
    for k, anchor in enumerate(chains):
        if k and anchor not in spotsigs.ANCHORS:
            continue
        chain, skipped = [], 0
        for w in chains[k + 1 :]:
            if w in spotsigs.ANCHORS:
                skipped += 1
                if skipped > spotsigs.SKIP:
                    break
            else:
                chain.append(w)
                skipped = 0
                if len(chain) == spotsigs.CHAIN:
                    break
        if chain:
            out.add(" ".join([anchor, *chain]))
    return out or ({text} if text else set())


def test_fingerprints(written):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["the", "of", "y", "die", *prose(rng, 3).split()]) for _ in range(rng.randint(1, 40))) for i in range(0, 400, 2)}
    texts |= {7: "the the the", 9: "", 11: "ünï, ÇA! the Été_x", 13: texts[4]}
    rows = {r["doc_id"]: r for r in spotsigs.compare_edits(written([(i, t) for i, t in texts.items()])).collect()}
    order = sorted(texts, reverse=True)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        t, r = texts[i], rows[i]
        third = len(t) // 3
        edited = t[: len(t) - third] + texts[after][:third]
        a, b, c = map(plain_signatures, (t, edited, texts[after]))
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert len(r["fingerprint"]) == 8 * len(a) and len(r["edited_fingerprint"]) == 8 * len(b)
        assert r["near_edited"] == pytest.approx(like(a, b)) and r["near_next"] == pytest.approx(like(a, c))
    assert rows[13]["fingerprint"] == rows[4]["fingerprint"]


def test_fingerprints_over_many_ranges(written, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_BYTES", 400)
    rng = random.Random(3)
    texts = {i: f"text number {i} of " + prose(rng, 5) for i in range(300)}
    rows = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(written(list(texts.items()))).collect()}
    assert rows == {i: texts[i - 1] if i else texts[299] for i in texts}


def test_spotsigs_links(written):
    rng = random.Random(4)
    base = [prose(rng, 60).replace("alpha", "the") for _ in range(12)]
    texts = {}
    for k, b in enumerate(base):
        for c in range(4):
            w = b.split()
            if c:
                w[rng.randrange(len(w))] = f"new{c}"
            texts[10 * k + c] = " ".join(w)
    sets = {i: plain_signatures(t) for i, t in texts.items()}
    parent = {i: i for i in texts}
    for _ in texts:
        for a, b in itertools.combinations(texts, 2):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.75:
                parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["doc_id"]: r["component_id"] for r in spotsigs.near_duplicates(written(list(texts.items()))).collect()}
    assert got == parent


# nearest neighbours


@pytest.mark.parametrize("clustered", [True, False])
def test_recall(spark, clustered):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 24)) + (3 * rng.normal(size=(20, 24))[rng.integers(0, 20, 6000)] if clustered else 0)
    x[4000:5500] = x[0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x = x.astype(np.float32).astype(np.float64)
    hit = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(6000), d))[:10]
        hit += len(set(want.tolist()) & {v for v, _ in got[q]})
        assert len(got[q]) == 10 and all(s == pytest.approx(d[v], abs=1e-12) for v, s in got[q]) and got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))
    assert hit / 600 >= 0.9


def test_repeated_ids_are_one_candidate(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    ids = np.arange(1500)
    far = rng.normal(size=(500, 8)).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True) for _ in range(2)] + [(7, v.tolist()) for v in far]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    every, named = np.concatenate([x, far]).astype(np.float64), np.concatenate([ids, np.full(500, 7)])
    hit = 0
    for q in range(0, 1500, 100):
        d = np.full(1500, np.inf)
        np.minimum.at(d, named, np.sqrt(((every - every[q]) ** 2).sum(axis=1)))
        d[q] = np.inf
        hit += len(set(np.lexsort((ids, d))[:10].tolist()) & {v for v, _ in got[q]})
        assert len({v for v, _ in got[q]}) == len(got[q]) == 10
        assert all(s >= d[v] - 1e-12 and (v == 7 or s == pytest.approx(d[v], abs=1e-12)) for v, s in got[q])
    assert hit / 150 >= 0.9
    one = lambda parts: ann.nearest(np.array([[0.0], [1.0], [0.5], [9.0]]), np.array([1, 1, 2, 3]), np.array([0, 5, 5, 0]), np.array([[1.0]]), np.array([3]), [parts], 2)
    assert [x.tolist() for x in one(None)] == [[0, 0], [1, 2], [0.0, 0.5]]
    assert [x.tolist() for x in one([5])] == [[0, 0], [1, 2], [0.0, 0.5]] and [x.tolist() for x in one([0])] == [[0], [1], [1.0]]


def share_compared(table, n):
    """Of all rows, those that a query is compared with."""
    router = ann.fit(table.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")), n)
    x = np.array([r["embedding"] for r in table.select("embedding").collect()], dtype=np.float64)
    size = np.bincount(router.best(x, 1)[:, 0], minlength=router.parts)
    return size[router.best(x[:100], router.probes)].sum(axis=1).mean() / n, router.parts


def test_recall_on_the_given_vectors(spark, sf_dir):
    """Directions without any structure, of which no partition can tell neighbours apart well."""
    table = spark.read.parquet(f"{sf_dir}/../sf0.1/embeddings.parquet").cache()
    x = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in table.collect()}
    ids, every = np.array(sorted(x)), np.stack([x[i] for i in sorted(x)])
    hit = n = 0
    got = collections.defaultdict(set)
    for r in ann.search(table, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    for i in ids[ids % 50 == 0]:
        d = np.sqrt(((every - x[i]) ** 2).sum(axis=1))
        d[ids == i] = np.inf
        hit, n = hit + len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & got[i]), n + 10
    assert hit >= 0.9 * n
    share, parts = share_compared(table, len(x))
    assert share <= 0.6 and parts > 200


def test_few_rows_are_compared_where_vectors_have_structure(spark):
    rng = np.random.default_rng(15)
    for x in (rng.normal(size=(6000, 24)) + 3 * rng.normal(size=(60, 24))[rng.integers(0, 60, 6000)], rng.normal(size=(6000, 6)) @ rng.normal(size=(6, 24))):
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        share, parts = share_compared(table, 6000)
        assert share <= 0.05 and parts > 500


# personal data


PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out)]


TRICKY = ["a@b@c.d x@y.z.", "a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4111 1111 1111 1111 5555-5555-5555-4444 4111111111111112", "+1 (555) 123-4567 +44.20.7946.0958) +1", "é a.b%c+d-e@ü.de f@g-h.co.uk", "1.2.3.4@x.y +12345678901@z.w"]


def test_base_entities(spark, sf_dir, texts, written):
    for r in queries.op6_pii(spark, sf_dir).collect():
        want = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, r["spans"].split(",")))
        assert [r[f"n_{k}"] for k, _ in PLAIN] == [sum(s.startswith(k + ":") for s in want) for k, _ in PLAIN]
    rng = random.Random(7)
    made = TRICKY + ["".join(rng.choice("ab1234.@+- ()") for _ in range(60)) for _ in range(300)]
    for text in made:
        assert [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in pii.seeds(text)] == plain_spans(text)


def test_contexts_discover(written):
    rng = random.Random(8)
    rows = [(i, f"{prose(rng, 5)} helpdesk dial +1 (555) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} {prose(rng, 4)}") for i in range(60)]
    rows += [(100, "omega helpdesk dial 555-867-5309 omega"), (101, "part number 555-867-5310 omega"), (102, "helpdesk dial 5558675309"), (103, "helpdesk dial 01 23 45 67 89 now")]
    rows += [(104, "+1 (826) 555-4081 190.137.223.204"), (105, "page 5558675309 and 7 of 12")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if not s["seed"]] for r in pii.extract(written(rows)).collect()}
    assert {i: got.pop(i) for i in (100, 102, 103)} == {100: [("phone", 20, 32)], 102: [("phone", 14, 24)], 103: [("phone", 14, 28)]}
    # its shape; and the same number elsewhere
    assert got.pop(104) == [("phone", 0, 17)] and got.pop(105) == [("phone", 5, 15)] and not any(got.values())
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(written(rows)).collect()}
    assert redacted[100] == "omega helpdesk dial [PHONE] omega" and redacted[101] == rows[61][1] and "[PHONE]" in redacted[0] and "555" not in redacted[0]


def test_discovered_identifiers_induce_patterns(written):
    """A context without any seed is found from what was discovered in another one, and finds what is new there."""
    rng = random.Random(5)
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    known = [number() for _ in range(40)]
    around = lambda before, n, after: f"{prose(rng, 4)} {before} {n} {after} {prose(rng, 4)}"
    rows = [around("helpdesk dial", f"+1 (555) {number()[4:]}", "now") for _ in range(60)]
    rows += [around("helpdesk dial", n, "now") for n in known] + [around("pager unit", n, "please") for n in known]
    new = len(rows)
    rows += [around("pager unit", number(), "please") for _ in range(5)]
    clean = len(rows)
    rows += [around("invoice total", number(), "due") for _ in range(30)] + [prose(rng, 20) for _ in range(10)]
    got = {r["doc_id"]: r["spans"] for r in pii.extract(written(list(enumerate(rows)))).collect()}
    assert all([rows[i][s["start"] : s["end"]] for s in got[i]] == re.findall("[0-9]{3}-[0-9]{3}-[0-9]{4}", rows[i]) for i in range(60, clean)) and clean == new + 5
    assert not any(got[i] for i in range(clean, len(rows)))


def test_long_identifiers_of_equal_beginnings_differ():
    assert pii.value("7" * 300) != pii.value("7" * 301) and pii.value("A(at)b.c 1") == "a@bc1"


def planted_identifiers(rng, n):
    """Texts with an identifier each in contexts of their kinds, a third of them in forms that the expressions don't know, and with numbers that are none; and where the unknown ones are."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    card = lambda: next(d for d in iter(lambda: digits(16), "") if pii.luhn(d))
    word = lambda: rng.choice(prose(rng, 1).split())
    kinds = {
        "phone": (["helpdesk dial", "ring me at", "fax line"], lambda: f"+1 (555) {rng.randint(200, 999)}-{digits(4)}", [lambda: digits(10), lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: " ".join(digits(2) for _ in range(5))]),
        "card": (["charged to card", "visa ending account", "card no"], card, [lambda: f"{digits(4)}.{digits(4)}.{digits(4)}.{digits(4)}", lambda: next(d for d in iter(lambda: digits(16), "") if not pii.luhn(d))]),
        "ip": (["from host", "login address"], lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), [lambda: "-".join(str(rng.randint(0, 255)) for _ in range(4))]),
        "email": (["write to", "contact mailbox"], lambda: f"{word()}.{digits(2)}@mail{digits(1)}.example.com", [lambda: f"{word()}{digits(2)} (at) mail{digits(1)} (dot) org", lambda: f"{word()}@intranet"]),
    }
    texts, want = {}, set()
    for i in range(n):
        kind = rng.choice(sorted(kinds))
        contexts, known, unknown = kinds[kind]
        new = rng.random() < 1 / 3
        string = rng.choice(unknown)() if new else known()
        text = f"{prose(rng, rng.randint(3, 20))} {rng.choice(contexts)} "
        if new:
            want.add((i, kind, len(text), len(text) + len(string)))
        text += f"{string} {prose(rng, rng.randint(3, 20))} page {digits(3)} of {digits(10)} {prose(rng, 3)} order {digits(16)} since {rng.randint(1900, 2020)} {prose(rng, 2)} {rng.randint(1, 9)}th"
        texts[i] = text
    return texts, want


def test_unseen_identifiers_are_found(written):
    texts, want = planted_identifiers(random.Random(22), 600)
    rows = pii.digests(pii.extract(written(list(texts.items())))).collect()
    got = {(r["doc_id"], k, int(a), int(e)) for r in rows for k, a, e in (s.split(":") for s in filter(None, r["spans"].split(",")))}
    base = {(i, k, int(a), int(e)) for i, t in texts.items() for k, a, e in (s.split(":") for s in plain_spans(t))}
    assert base <= got and len(want) > 150
    added = got - base
    assert sum(r["n_discovered"] for r in rows) == len(added)
    assert len(added & want) >= 0.9 * len(want - base) and len(added & want) >= 0.95 * len(added)


# language model


def test_suffix_tree_counts_and_scores(spark, sf_dir, texts):
    counts = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    better = held = 0
    for r in queries.op7_suffix_tree(spark, sf_dir).collect():
        x = [*words(texts[r["doc_id"]]), "\n"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(w in counts for w in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / ((n + 1) * (v + 1))) for w in x))
        if r["held_out"]:
            held, better = held + 1, better + (r["score"] > r["base_score"])
    assert better > 0.95 * held


def test_suffix_tree_base_adds_one_to_each_count(written):
    """The contract's (c + 1) / (N + 1 * (V + 1)): one is added to the count of every distinct token and of one unknown, so these sum to 1."""
    rows = {i: t for i, t in enumerate(["a b a", "B\u00a0c  d", "", None, "a", "zz a\x1fb", "b b", "q", "a b c"])}
    trains = {i for i in rows if zlib.crc32(str(i).encode()) % 7 != 2}
    rows[next(i for i in range(9, 99) if zlib.crc32(str(i).encode()) % 7 == 2)] = "a never seen"
    tokens = {i: [*words(t or ""), "\n"] for i, t in rows.items()}
    counts = collections.Counter(w for i in trains for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r["base_score"] for r in suffix_tree.score(written(list(rows.items())), (2, 7)).collect()}
    assert got == {i: pytest.approx(sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in x)) for i, x in tokens.items()}


def plain_tree(docs, trains, depth=suffix_tree.DEPTH, least=suffix_tree.DIVERGENCE):
    """The score of each token sequence, from dictionaries of whole contexts; and the contexts that are kept."""
    counts, follow, pairs = collections.Counter(), collections.defaultdict(collections.Counter), np.full((256, 256), 0.01)
    texts = {i: [*words(t), "\n"] for i, t in docs.items()}
    for i, x in texts.items():
        if trains(i):
            counts.update(x)
            for w in x[:-1]:
                for a, b in itertools.pairwise(b" " + w.encode() + b" "):
                    pairs[a, b] += 1
            for at, k in itertools.product(range(len(x)), range(1, depth + 1)):
                if k <= at:
                    follow[tuple(x[at - k : at])][x[at]] += 1
    n, v = sum(counts.values()), len(counts)
    pairs /= pairs.sum(axis=1, keepdims=True)
    spelt = lambda w: math.prod(pairs[a, b] for a, b in itertools.pairwise(b" " + w.strip("\n").encode() + b" "))

    def elsewhere(context, w):
        if not context:
            return max(counts[w] - 1, 0.5) / (n + v)
        f = follow[context]
        d, all_ = len(f) - (f[w] == 1), sum(f.values())
        return (f[w] - 1 + d * elsewhere(context[1:], w)) / (all_ - 1 + d) if all_ - 1 + d else elsewhere(context[1:], w)

    kept = set()
    for c, f in follow.items():
        if sum(m * math.log(elsewhere(c, w) / elsewhere(c[1:], w)) for w, m in f.items()) >= least:
            kept |= {c[k:] for k in range(len(c))}

    def p(context, w):
        if not context:
            return (counts[w] + max(v, 1) * spelt(w)) / (n + max(v, 1))
        f = follow[context]
        return (f[w] + len(f) * p(context[1:], w)) / (sum(f.values()) + len(f))

    longest = lambda x, at: next(c for k in range(min(depth, at), -1, -1) if not (c := tuple(x[at - k : at])) or c in kept)
    return {i: sum(math.log10(p(longest(x, at), w)) for at, w in enumerate(x)) for i, x in texts.items()}, kept


def test_suffix_tree_against_a_plain_one(spark, sf_dir, texts):
    want, kept = plain_tree(texts, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    assert len(kept) > 100 and {len(c) for c in kept} == {1, 2}
    got = {r["doc_id"]: r["score"] for r in queries.op7_suffix_tree(spark, sf_dir).collect()}
    assert got == pytest.approx(want, rel=1e-5)


def test_suffix_tree_learns_order(written):
    rng = random.Random(20)
    vocabulary = [f"w{k}" for k in range(40)]
    after = {w: rng.sample(vocabulary, 2) for w in vocabulary}
    texts = {}
    for i in range(400):
        x = [rng.choice(vocabulary)]
        while len(x) < 30:
            x.append(rng.choice(after[x[-1]]))
        texts[i] = " ".join(x)
    shuffled = {1000 + i: " ".join(rng.sample(t.split(), 30)) for i, t in texts.items()}
    trains = lambda d: zlib.crc32(str(d).encode()) % 7 != 2
    rows = texts | {i: t for i, t in shuffled.items() if not trains(i)}
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(written(list(rows.items())), (2, 7)).collect()}
    held = [i for i in texts if not trains(i)]
    # two ways on from each word, about a bit a word; the end comes once in 31 tokens; without order more than five bits
    assert len(held) > 30 and all(got[i] > -30 * math.log10(2.4) - 5 for i in held)
    assert all(got[i] < -30 * math.log10(10) for i in shuffled if i in got)


@pytest.mark.parametrize("frequent", [1e-6, 0.02])
def test_suffix_tree_tells_words_apart(written, monkeypatch, frequent):
    # the hashes of the two words agree in their lower 28 bits; words beside a known one are frequent ones and others
    a, b = (shingles.word_hashes(w)[0] for w in (b"w1335", b"w26910"))
    assert a != b and (a ^ b) & np.uint64((1 << 28) - 1) == 0
    monkeypatch.setattr(suffix_tree, "FREQUENT", frequent)
    trains = lambda d: zlib.crc32(str(d).encode()) % 7 != 2
    held = [i for i in range(200) if not trains(i)]
    rng = random.Random(25)
    texts = {i: f"ctx w1335 of ctx {rng.choice(['w1335', 'of', f'x{i}'])} y{i % 9} w1335" for i in range(200)}
    texts |= dict(zip(held, ["ctx w26910", "ctx w26911", "ctx w1335", "of ctx w26910", "of ctx w1335", "w26910 ctx w1335", "w1335 ctx w1335"], strict=False))
    want, _ = plain_tree(texts, trains, least=-math.inf)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(written(list(texts.items())), (2, 7), divergence=-math.inf).collect()}
    assert got == pytest.approx(want, rel=1e-5)
    assert got[held[0]] < -10 < -4 < got[held[2]]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_suffix_tree_in_many_buckets(monkeypatch, depth):
    monkeypatch.setattr(suffix_tree, "TOKENS_A_PART", 30)  # frequent words are in several parts
    rng = random.Random(21)
    base = prose(rng, 40)
    texts = {i: " ".join(rng.choice(["the", "the", "of", "a", rng.choice("bcdef"), f"x{rng.randrange(30)}"]) for _ in range(rng.randint(0, 25))) + (" " + base if i % 5 == 0 else "") for i in range(120)}
    trains = lambda i: i % 4 != 1
    want, _ = plain_tree(texts, trains, depth)
    groups = [list(texts)[k::3] for k in range(3)]
    counts, pairs, blocks_ = collections.Counter(), np.zeros(1 << 16), []
    for k, group in enumerate(groups):
        block = suffix_tree.Block(k, 0)
        for i in group:
            around = block.add(i, texts[i].encode(), None)
            if trains(i):
                pairs += np.bincount(around[:-1].astype(np.int64) * 256 + around[1:], minlength=1 << 16)
                counts.update(block.hashes[-1].tolist())
        block.seal()
        blocks_.append(block)
    order = sorted(counts)
    shared = suffix_tree.Words(np.array(order, np.uint64), np.array([counts[w] for w in order], float), sum(counts.values()), len(counts))
    spelling = suffix_tree.spelling_table(pairs)
    found = [suffix_tree.contexts(b.tokens, b.sizes, np.array([trains(i) for i in b.ids]), shared, 11, depth) for b in blocks_]
    asked = collections.defaultdict(list)
    for k, c in enumerate(found):
        for bucket, payload in suffix_tree.questions(c):
            asked[bucket].append((k, payload))
    assert len(asked) > 5
    told = collections.defaultdict(list)
    for bucket in sorted(asked):
        for (k, _), reply in zip(asked[bucket], suffix_tree.answers([p for _, p in asked[bucket]], shared, depth), strict=True):
            told[k].append(reply)
    for k, (b, c) in enumerate(zip(blocks_, found, strict=True)):
        again = suffix_tree.Block(k, 0)
        for i in b.ids:
            again.add(i, texts[i].encode(), spelling)
        c_of = np.array([counts.get(w, 0) for w in b.tokens.tolist()], float)
        root = (c_of + shared.v * 10 ** np.concatenate(again.spelt).astype(float)) / (shared.n + shared.v)
        scores = suffix_tree.log_scores(c, root, suffix_tree.read_answers(told[k], depth))
        ends = np.cumsum(b.sizes)
        for i, a, e in zip(b.ids, ends - b.sizes, ends, strict=True):
            assert scores[a:e].sum() == pytest.approx(want[i], rel=1e-5)


# mixing


def test_schedule_keeps_within_a_block(spark):
    for shares, period in (([500, 300, 200], 1000), ([1, 1, 1, 997], 1000), ([7], 7), ([3, 3, 1], 7)):
        df = spark.createDataFrame([(shares,)], "s array<int>")
        runs = df.select(mixing.schedule(F.col("s"), period).alias("r")).first()["r"]
        got = np.cumsum(np.eye(len(shares), dtype=int)[runs], axis=0)
        ideal = np.arange(1, period + 1)[:, None] * np.array(shares) / period
        assert (np.abs(got - ideal) < 1).all() and got[-1].tolist() == shares


def test_mix(written):
    rng = random.Random(9)
    rows = [(i, f"t{i}", rng.choice("aaaaabbc") if i % 50 else None) for i in range(5000)]
    docs = written(rows, "doc_id long, text string, source string")
    weights = docs.sparkSession.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 1.0), (mixing.NO_SOURCE, 1.0), ("gone", 9.0)], "source string, weight double")
    got = mixing.interleave(docs, weights, 100, 16).select("doc_id", "text", "source", "mix.*").collect()
    assert sorted(r["position"] for r in got) == list(range(5000)) and sorted(r["doc_id"] for r in got) == list(range(5000))
    by = collections.defaultdict(set)
    size = collections.Counter()
    for r in got:
        s = r["source"] or mixing.NO_SOURCE
        by[s].add((r["slot"], r["block"], r["place"]))
        size[s, r["block"]] += 1
    places = sorted(p for v in by.values() for _, _, p in v)
    assert places == list(range(len(places))) and max(size.values()) == 16
    ordered = sorted(got, key=lambda r: r["position"])
    assert [r["place"] for r in ordered] == sorted(r["place"] for r in ordered)
    # until the first source ends, no source is a block or more away from its weight
    share = {"a": 0.5, "b": 0.3, "c": 0.1, mixing.NO_SOURCE: 0.1}
    ends = min(max(s for s, _, _ in v) for v in by.values())
    for t in range(1, ends + 1):
        assert all(abs(sum(s < t for s, _, _ in v) - share[k] * t) < 1 for k, v in by.items())
    with pytest.raises(ValueError, match="no weight"):
        mixing.interleave(docs, weights.filter("source <> 'a'"))


def test_more_sources_than_slots(written, monkeypatch):
    monkeypatch.setattr(mixing, "PERIOD", 10)
    monkeypatch.setattr(mixing, "SOURCES_A_PERIOD", 5)
    rng = random.Random(23)
    rows = [(i, f"t{i}", f"site{i if i < 23 else rng.randrange(23)}") for i in range(300)]
    docs = written(rows, "doc_id long, text string, source string")
    got = mixing.interleave(docs, block_rows=1).select("doc_id", "source", "mix.*").collect()
    assert sorted(r["position"] for r in got) == list(range(300))
    # 23 sources have 50 slots
    assert len({r["source"] for r in got if r["slot"] < 50}) == 23
    with pytest.raises(ValueError, match="sources"):
        mixing.interleave(docs, period=20)


def test_many_sources_against_slots_in_order(written):
    rng = random.Random(26)
    rows = [(i, f"t{i}", f"site{i if i < 150 else int(150 * rng.random() ** 3)}") for i in range(6000)]
    got = mixing.interleave(written(rows, "doc_id long, text string, source string"), block_rows=4).select("doc_id", "source", "mix.*").collect()
    # places and positions, from the slots of the blocks
    size = collections.Counter((r["slot"], r["source"], r["block"]) for r in got)
    assert len({k[0] for k in size}) == len(size)
    place, start, at = {}, {}, 0
    for k, (slot, source, block) in enumerate(sorted(size)):
        place[source, block], start[source, block] = k, at
        at += size[slot, source, block]
    for r in got:
        key = r["source"], r["block"]
        assert (r["place"], r["position"]) == (place[key], start[key] + r["source_row"] % 4)


def test_shares_add_up(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 1e-9)], "source string, weight double")
    got = {r["source"]: r["share"] for r in mixing.shares(w, 100).collect()}
    assert sum(got.values()) == 100 and got["d"] == 1 and max(got.values()) == 33


# near copies


def brute_components(texts, percent=75):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for a, b in {p for v in where.values() for p in itertools.combinations(sorted(v), 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_copies(spark, sf_dir, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op9_minhash_forest(spark, sf_dir).collect()}
    assert got == brute_components(texts)


def test_large_group_of_near_copies(written):
    rng = random.Random(10)
    base = prose(rng, 90).split()
    texts = {}
    for i in range(500):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    texts |= {1000 + i: "one shared passage of quite a few words in many texts " + prose(rng, rng.randint(3, 30)) for i in range(200)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_forest.near_duplicates(written(list(texts.items()))).collect()}
    assert got == brute_components(texts)


def template_texts(n, linked):
    """Texts that share a template (J about 0.6), of which the first `linked` pairs share more (J about 0.76)."""
    template = [f"t{k}" for k in range(94)]
    texts = {}
    for i in range(n):
        own = [f"o{i}x{k}" for k in range(30)]
        if i < 2 * linked:
            m = 13 + i // 2 % 2
            own[:m] = [f"p{i // 2}x{k}" for k in range(m)]
        texts[i] = " ".join(template + own)
    return texts


def test_links_in_a_crowd_of_one_template(written):
    texts = template_texts(2000, 300)
    sets = {i: set(shingles.shingle_set(t).tolist()) for i, t in texts.items()}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    want = {i: i - 1 if i % 2 and alike(i, i - 1) else i for i in texts}
    assert sum(want[i] != i for i in texts) == 300 and not alike(0, 2) and not alike(1, 1999)
    got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(written(list(texts.items()))).collect()}
    assert got == want


def test_a_group_is_not_compared_with_each_of_its_stragglers_in_full(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    group, near, far = range(60), range(100, 130), range(200, 205)
    own = lambda i, n: np.concatenate([base[:n], np.uint64(1 << 63) + np.uint64(100 * i) + np.arange(62 - n, dtype=np.uint64)])
    sets = {i: np.sort(own(i, 40 if i in far else 60)) for i in (*group, *near, *far)}
    rows = spark.createDataFrame([(i, s.tobytes()) for i, s in sets.items()], "rep long, shingles binary")
    # the group is one component, of which only a few are near one more
    one = {130: np.sort(np.concatenate([sets[7][:56], own(130, 0)[:6]]))}
    rows = rows.unionByName(spark.createDataFrame([(i, s.tobytes()) for i, s in one.items()], "rep long, shingles binary"))
    sets |= one
    pairs = spark.createDataFrame([(g, i, 0, i, 1) for g in group for i in (*near, *far, 130)], "a long, b long, low long, high long, n long")
    seen, confirmed = [], minhash_forest._confirmed
    monkeypatch.setattr(minhash_forest, "_confirmed", lambda p, s, percent: (seen.append(p.count()), confirmed(p, s, percent))[1])
    links = {(r["u"], r["v"]) for r in minhash_forest._joined(pairs, rows, 75).collect()}
    assert all(minhash_forest.linked(sets[a], sets[b], 75) for a, b in links)
    want = {i for i in sets if any(g != i and minhash_forest.linked(sets[g], sets[i], 75) for g in group)}
    assert {b for _, b in links} == want - set(group)
    # far ones with all of the group, near ones with a few
    assert len(group) * len(far) < sum(seen) < len(group) * (len(far) + 1) + 4 * len(near) + 1


def test_sets_travel_only_for_pairs_that_sketches_leave_open(written, monkeypatch):
    rng = np.random.default_rng(23)
    base = [f"w{k}" for k in range(300)]
    # one run of new words in each text: likeness about 0.82 to the base and 0.67 to each other, or about 0.6 and 0.3
    near, far = ([[*base[:at], *(f"{name}{at}x{k}" for k in range(n)), *base[at + n :]] for at in range(5, 290 - n, n + 3)] for name, n in (("n", 26), ("f", 70)))
    texts = {i: " ".join(t) for i, t in enumerate([base, *near, *far])}
    texts |= {100 + i: " ".join(f"q{w}" for w in rng.integers(0, 10_000, 50)) for i in range(20)}
    seen, confirmed = [], minhash_forest._confirmed
    monkeypatch.setattr(minhash_forest, "_confirmed", lambda p, s, percent: (seen.extend((r["a"], r["b"]) for r in p.collect()), confirmed(p, s, percent))[1])
    got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(written(list(texts.items()))).collect()}
    sets = {i: shingles.shingle_set(t) for i, t in texts.items()}
    link = lambda a, b: minhash_forest.linked(sets[a], sets[b], 75)
    assert all(link(0, i) for i in range(1, 1 + len(near))) and not any(link(0, i) for i in texts if i > len(near))
    assert got == {i: 0 if i <= len(near) else i for i in texts}
    assert seen and all(a <= len(near) and b <= len(near) for a, b in seen)


def test_sketches_leave_every_link_open():
    rng = np.random.default_rng(29)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for n in (1, 7, 70, 700, 7000):
        for j in (0.75, 0.8, 1.0):
            own = int(n * (1 - j) / (1 + j))
            for a_own, b_own in ((own, own), (2 * own, 0)):
                both = draw(n - own)
                a, b = (np.unique(np.concatenate([both, draw(k)])) for k in (a_own, b_own))
                rows = [(1, rep, rep, len(s), minhash_forest._sketch(s)) for rep, s in ((5, b), (3, a))]
                batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["key", "rep", "component", "n", "sketch"])
                pairs = [tuple(r.values())[:4] for x in minhash_forest._complete(75)(iter([batch])) for r in x.to_pylist()]
                assert minhash_forest.linked(a, b, 75) and pairs == [(3, 5, 3, 5)]


def test_suffix_tree_sorts_numbers_and_no_index(monkeypatch):
    rng = np.random.default_rng(31)
    unique = np.unique
    same = lambda got, want: all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    top = np.uint64(1 << 40)
    for hashes in (rng.integers(0, 1 << 64, 5000, dtype=np.uint64)[rng.integers(0, 5000, 20_000)], np.array([5, 3, 5, 4, 3], np.uint64) + top, np.zeros(0, np.uint64)):
        assert same(suffix_tree._distinct(hashes), unique(hashes, return_inverse=True))
    for most_high, most_low, n in ((1000, 300, 9000), (1, 1, 5), (1 << 32, 1 << 32, 3000), (9, 9, 0)):
        high, low = (rng.integers(0, most, n, dtype=np.uint64) for most in (most_high, most_low))
        keys, at = unique((high << np.uint64(32)) | low, return_inverse=True)
        assert same(suffix_tree._distinct_pairs(high, low), (keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF), at))
    # a block's words are told apart once, and what follows them without an index of all positions
    sorts = []
    monkeypatch.setattr(suffix_tree.np, "unique", lambda *a, **b: (sorts.append(len(a[0])), unique(*a, **b))[1])
    tokens, sizes = shingles.mix(rng.integers(0, 400, 6000).astype(np.uint64)), np.full(60, 100)
    hashes, counts = unique(tokens, return_counts=True)
    words = suffix_tree.Words(hashes[:50], counts[:50].astype(float), 6000, len(hashes))
    asked = [payload for _, payload in suffix_tree.questions(suffix_tree.contexts(tokens, sizes, np.ones(60), words, 1, 2))]
    known = unique(tokens, return_inverse=True)
    assert asked == [payload for _, payload in suffix_tree.questions(suffix_tree.contexts(tokens, sizes, np.ones(60), words, 1, 2, known))]
    suffix_tree.answers(asked, words)
    assert not sorts


def test_sieve(spark, monkeypatch):
    ids = spark.range(-1000, 200_000, 7).toDF("doc_id")
    for bits, most in ((common.SIEVE_BITS, 0.1), (1 << 16, 1.0)):
        monkeypatch.setattr(common, "SIEVE_BITS", bits)
        passes = common.sieve(ids, ids.count())
        assert ids.filter(~passes(F.col("doc_id"))).isEmpty()
        assert spark.range(300_000, 310_000).filter(passes(F.col("id"))).count() <= 10_000 * most
    assert spark.range(1000).filter(common.sieve(ids.limit(0), 0)(F.col("id"))).isEmpty()


def test_regions_that_tasks_share_are_whole():
    rows = [(k, d, rep) for k, n in ((1, 3), (2, 1), (3, 2), (4, 1), (5, 2)) for d, rep in enumerate(range(10 * k, 10 * k + n))]
    want = {(k, rep) for k, _, rep in rows if k in (1, 3, 5)}
    for cut in range(1, len(rows)):
        told = set()
        for part in (rows[:cut], rows[cut:]):
            for size in (1, 4):
                batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in part[at : at + size]], pa.int64()) for c in range(3)], names=["key", "deeper", "rep"]) for at in range(0, len(part), size)]
                got = [tuple(r.values()) for b in minhash_forest._neighbours(iter(batches)) for r in b.to_pylist()]
                told |= {(r[0], r[2]) for r in got}
        assert want <= told


def test_how_regions_are_compared_does_not_matter(spark, sf_dir, docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_forest.near_duplicates(docs, pairs_a_row=0).collect()}
    assert got == brute_components(texts)


def test_shingles_are_sets_of_words():
    a = shingles.shingle_set("The  quick\tbrown fox\njumps over")
    assert len(a) == 2 and np.array_equal(a, shingles.shingle_set("the quick brown fox jumps over"))
    assert len(shingles.shingle_set("É a")) == 1 and not np.array_equal(shingles.shingle_set("É a"), shingles.shingle_set("é a"))


def test_components_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(components, "EDGES_A_TASK", 40)
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(0, 150) if i % 50] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)]
    parent = {n: n for e in edges for n in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == {n: find(n) for n in parent} and len(got) == len(parent)


# token counts


def test_counts_are_the_librarys(spark, sf_dir, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    want = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in queries.op10_token_counts(spark, sf_dir).collect():
        assert r["n_tokens"] == want(texts[r["doc_id"]])
    counter = unigram_counts.Counter(unigram_counts.load(public_tokenizers.path("piece_bpe_32k.model")))
    rng = random.Random(12)
    for _ in range(300):
        t = "x" + "".join(rng.choice("abc  éß漢🙂\n.,") for _ in range(40))
        assert counter.text(t) == want(t), t


def test_ties_go_to_the_longest_last_piece():
    count = unigram_counts.Counter(unigram_counts.Vocabulary({"▁": 0.0, "a": -1.0, "b": -1.0, "c": -1.0, "ab": -2.0, "bc": -1.0, "abc": -2.0}))
    assert count.text("abc") == 2  # ▁ abc, as good as ▁ a bc


# the pipeline


def test_pipeline(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            docs = common.materialize(docs, "stage")
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    known, first, clean, mixed = kept
    assert len(known) >= 0.98 * len(texts) and all(known[i] == texts[i] for i in known)
    assert set(first) == {i for i, (_, c) in brute_components(known).items() if i == c}
    for i, t in clean.items():
        assert not plain_spans(t) and (t == first[i]) == (not plain_spans(first[i]))
    assert mixed == clean
    library = reference_encoding()
    out = {r["doc_id"]: r for r in docs.collect()}
    assert set(out) == set(mixed)
    for i, t in mixed.items():
        assert out[i]["ids"] == library.encode_ordinary(t) and out[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_mixed_files_are_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = [r["doc_id"] for r in mixing.interleave(docs).orderBy("mix.position").select("doc_id").collect()]
    assert [r["doc_id"] for r in corpus_pipeline.mixed(spark, docs, sf_dir).collect()] == want


@pytest.mark.parametrize("few", [0, 100_000])
def test_the_mix_is_the_order_of_the_result(spark, sf_dir, monkeypatch, few):
    monkeypatch.setattr(corpus_pipeline, "FEW_FILES", few)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        got = {r["position"]: r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.col("doc_id").isin(list(got.values())))
    want = [r["doc_id"] for r in mixing.interleave(docs).orderBy("mix.position").select("doc_id").collect()]
    assert [got[k] for k in range(len(got))] == want


def test_suffix_tree_holds_few_bytes_a_position():
    rng = np.random.default_rng(33)
    draw = lambda: shingles.mix(rng.zipf(1.3, 200_000).astype(np.uint64) % np.uint64(100_000))
    sizes, trains = np.full(400, 500), np.arange(400) % 7 != 2
    blocks_ = [draw() for _ in range(6)]
    hashes, counts = np.unique(np.concatenate(blocks_), return_counts=True)
    words = suffix_tree.Words(hashes[counts > 3], counts[counts > 3].astype(float), 1_200_000, len(hashes))

    def peak(f):
        tracemalloc.start()
        try:
            return f(), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    known = suffix_tree._distinct(blocks_[0])
    found, most = peak(lambda: suffix_tree.contexts(blocks_[0], sizes, trains, words, 1, 2, known))
    # 32 bits for each of some numbers of a position, and what is sorted at a time
    assert most < 120 * len(blocks_[0])
    root = np.full(len(blocks_[0]), 1e-5)
    asked = [payload for x in blocks_ for _, payload in suffix_tree.questions(suffix_tree.contexts(x, sizes, trains, words, 1, 2))]
    told, most = peak(lambda: suffix_tree.answers(asked, words))
    entries = sum(len(level.which) for p in asked for level in suffix_tree._read_question(p, 2))
    assert most < 80 * entries
    got = suffix_tree.read_answers(told[:1], 2)
    _, most = peak(lambda: suffix_tree.log_scores(found, root, got))
    assert most < 40 * len(root)
