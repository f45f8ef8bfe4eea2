"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, everything but letters becomes a space, and its 2- to 4-character subwords are hashed into
BUCKETS rows of an embedding table. The text's vector is the mean of those rows, a linear layer and softmax give the
language. Both layers are trained by stochastic gradient descent in numpy on a bounded, stratified sample of labelled
rows (at most about SAMPLE_PER_LANG a language and SAMPLE in all); a fifth of that sample calibrates a temperature. The
rejection threshold is what nearly all texts of random letters stay below, but it lies MARGIN, in log-odds, below what nearly
all of that fifth reach, and at REJECT_MOST at most. Prediction runs in Spark over whole texts.

Defined cases: a null text or one without a letter gives `und`, score 0 and is rejected; without any labelled row
every text is `und`; ties go to the first language in sorted order; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
DIM = 16
#: The bound of the fitting sample: expected labelled rows taken for each language.
SAMPLE_PER_LANG = 800
#: And of all together, however many languages there are.
SAMPLE = 16_000
BATCH, RATE, SEED = 32, 0.5, 11
#: Steps of gradient descent, whatever the sample's size.
STEPS = 1500
#: Share of clean validation rows that rejection may cost, share of random ones that it may let pass, and the highest threshold it may set.
REJECT_SHARE, PASS_SHARE, REJECT_MOST = 0.001, 0.05, 0.9
#: In log-odds: the least clean row of a larger table is less sure than that of the sample.
MARGIN = 0.8
#: Texts of random letters to calibrate with.
RANDOM_TEXTS = 300
CHUNK = 1 << 20
UNDETERMINED = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def subword_buckets(text: str | None):
    """Yield arrays of bucket numbers for the whole text, a bounded slice at a time."""
    if not text:
        return
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[max(0, at - 3) : at + CHUNK].lower().encode("utf-32-le", "replace"), dtype="<u4")
        letter = _letter_table()[codes]
        if not letter.any():
            continue
        # runs of other characters shrink to one space
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        codes = np.where(letter, codes, 32)[keep].astype(np.uint32)
        codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]]).astype(np.uint32)
        mixed = codes * np.uint32(0x9E3779B1)
        h = mixed ^ (mixed >> np.uint32(15))
        for n in (2, 3, 4):
            if len(codes) < n:
                break
            h = (h[:-1] * np.uint32(0x85EBCA6B)) ^ mixed[n - 1 :]
            h ^= h >> np.uint32(13)
            yield (h * np.uint32(0xC2B2AE35)) >> np.uint32(16)


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: the embedding times the linear layer
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        total, n = np.zeros(len(self.langs)), 0
        for b in subword_buckets(text):
            total += self.table[b].sum(axis=0, dtype=np.float64)
            n += len(b)
        if not n or not self.langs:
            return UNDETERMINED, 0.0, True
        p = _softmax((total / n + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(min(1.0, p[k])), bool(p[k] < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _sample(train: DataFrame) -> pd.DataFrame:
    """Bucket counts of a hash-chosen sample, stratified by language."""
    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not counts:
        return pd.DataFrame({"h": [], "lang": [], "b": [], "n": []})
    each = min(SAMPLE_PER_LANG, SAMPLE // len(counts))
    rates = F.create_map(*[F.lit(x) for k, c in sorted(counts.items()) for x in (k, min(1.0, each / c))])
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(SEED))
    picked = train.withColumn("h", h).filter(F.shiftrightunsigned("h", 11) / float(1 << 53) < rates[F.col("lang")])

    def features(batches):
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                all_b = [*subword_buckets(text)]
                b, n = np.unique(np.concatenate(all_b), return_counts=True) if all_b else (np.zeros(0), np.zeros(0))
                out.append((b.astype("<u2").tobytes(), n.astype("<f4").tobytes()))
            yield pd.DataFrame({"h": pdf["h"], "lang": pdf["lang"], "b": [x[0] for x in out], "n": [x[1] for x in out]})

    got = picked.select("h", "lang", "text").mapInPandas(features, "h long, lang string, b binary, n binary").toPandas()
    return got[got["b"].map(len) > 0].sort_values(["h", "lang"], kind="stable")


def fit(docs: DataFrame) -> LanguageModel:
    """Learn from the rows of `docs` (doc_id, text, lang) that carry a label and a text."""
    train = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = _sample(train)
    langs = sorted(rows["lang"].unique().tolist())
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    y = rows["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy()
    counts = [np.frombuffer(n, "<f4") for n in rows["n"]]
    xs = [(np.frombuffer(b, "<u2"), n / n.sum()) for b, n in zip(rows["b"], counts, strict=True)]
    del rows, counts
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(xs))
    held = order[: len(xs) // 5] if len(xs) >= 50 else order
    fitted = order[len(xs) // 5 :] if len(xs) >= 50 else order
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, (DIM, len(langs))), np.zeros(len(langs))
    epochs = -(-STEPS // -(-len(fitted) // BATCH))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(fitted), BATCH):
            batch = fitted[at : at + BATCH]
            mean = np.stack([xs[i][1] @ emb[xs[i][0]] for i in batch])
            g = _softmax(mean @ out + bias)
            g[np.arange(len(batch)), y[batch]] -= 1
            back = (g @ out.T * (-rate * 20.0 / len(batch))).astype(np.float32)
            out -= rate * mean.T @ g / len(batch)
            bias -= 0.1 * rate * g.mean(axis=0)
            # each text moves its own subwords; the mean spreads a step over them, so the step is scaled up
            for i, v in zip(batch, back, strict=True):
                b, w = xs[i]
                emb[b] += np.sqrt(w)[:, None] * v
        fitted = rng.permutation(fitted)
    logits = np.stack([xs[i][1] @ emb[xs[i][0]] for i in held]) @ out + bias
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.2, 5, 60), key=loss))
    model = LanguageModel(langs, (emb @ out).astype(np.float32), bias, temperature, 0.0)
    odds = lambda p: np.log(np.clip(p, 1e-12, 1 - 1e-12)) - np.log1p(-np.clip(p, 1e-12, 1 - 1e-12))
    clean = np.quantile(odds(_softmax(logits / temperature).max(axis=1)), REJECT_SHARE)
    junk = np.quantile(odds(np.array([model.predict(t)[1] for t in random_texts(rng)])), 1 - PASS_SHARE)
    model.threshold = float(min(REJECT_MOST, 1 / (1 + np.exp(-min(clean - MARGIN, junk)))))
    return model


def random_texts(rng: np.random.Generator, n: int = RANDOM_TEXTS) -> list[str]:
    """Texts of letters and blanks without any language."""
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz" + " " * 5))
    return ["".join(rng.choice(letters, size)) for size in rng.integers(20, 600, n)]


def predictor(spark, model: LanguageModel):
    """A column function text -> struct(lang_pred, score, rejected). The model travels once to each executor; its size is BUCKETS x languages."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return predict


def identify(docs: DataFrame, train_when: Column) -> DataFrame:
    """Every document with lang_pred, score and rejected, learnt from the rows where `train_when` holds."""
    predict = predictor(docs.sparkSession, fit(docs.filter(train_when)))
    return docs.select("doc_id", predict(F.col("text")).alias("p")).select("doc_id", "p.lang_pred", "p.score", "p.rejected")


def keep_known(docs: DataFrame, train_when: Column) -> DataFrame:
    """The rows of `docs` (with a text) whose language the model, learnt where `train_when` holds, does not reject.

    Without any labelled row there is no model to reject with, and all rows with a letter stay.
    """
    model = fit(docs.filter(train_when))
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    predict = predictor(docs.sparkSession, model)
    rows = docs.select(F.struct("*").alias("row"), predict(F.col("text")).alias("p"))
    return rows.filter(~F.col("p.rejected")).select("row.*")
