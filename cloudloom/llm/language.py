"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1; for each bit a logistic classifier over hashed byte n-grams of the whole lower-cased
text is trained here. Decoding weighs each bit's logistic loss by how often its classifier was right on rows set aside, and
takes the codeword of the least loss; score is that codeword's share of exp(-loss), and a text is ambiguous when the two best
losses differ by less than MARGIN. A text that is null or has no letter is `und` with score 0.

Rows to learn from: non-null lang and text, at most about SAMPLE, the same share of each language, chosen by a hash of doc_id.
Up to 7 codes the exhaustive code is used, beyond that a seeded random one of the largest least distance found.
With no row to learn from, every text is `und`. Of equal losses the first language by name is taken. A text of any length is read
whole. Rows are independent; repeated rows give repeated results. An empty table gives no rows. `predict` reads doc_id and text
only; `accepted` keeps extra columns, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import mapped, slices, table

SAMPLE, CELLS, MARGIN, STEPS = 3000, 4096, 0.05, 80
UNDETERMINED = "und"


def features(text: str, cells: int = CELLS) -> np.ndarray:
    """Square roots of the counts of n-grams of 2 to 4 bytes, across words too but without digits, hashed to cells, to length one."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    b = b[(b < 48) | (b > 57)]
    total = np.zeros(cells, np.int64)
    h = b
    for k in range(3):
        h = h[:-1] * np.uint32(0x9E3779B1) + b[k + 1 :] + np.uint32(k)
        total += np.bincount((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - int(cells).bit_length() + 1), minlength=cells)[:cells]
    v = np.sqrt(total, dtype=np.float32)
    return v / max(float(np.sqrt(v @ v)), 1e-9)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 and -1, with no constant column."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        n = 2 ** (k - 1) - 1
        return np.array([[1 if row == 0 or not (j + 1) >> (row - 1) & 1 else -1 for j in range(n)] for row in range(k)], float)
    rng, n, best, most = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k))), None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (k, n))
        least = min((m[i] != m[j]).sum() for i in range(k) for j in range(i))
        if least > most and (abs(m.sum(0)) < k).all():
            best, most = m, least
    return best


def lettered(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of each language for each row of features."""
        f = x @ self.weights + self.bias
        return np.stack([(np.logaddexp(0, -c * f) * self.trust).sum(1) for c in self.code], 1)

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not lettered(text):
            return UNDETERMINED, 0.0, True
        loss = self.losses(features(text)[None])[0]
        best = int(np.argmin(loss))
        p = np.exp(loss[best] - loss)
        rest = np.delete(loss, best)
        return self.langs[best], float(1 / p.sum()), bool(rest.size and rest.min() - loss[best] < MARGIN)


def fit(x: np.ndarray, y: list[str]) -> Model:
    """Gradient descent with momentum on all bits at once; every fifth row is set aside to weigh the bits."""
    langs = sorted(set(y))
    if not langs:
        return Model([], np.ones((0, 1)), np.zeros((CELLS, 1)), np.zeros(1), np.ones(1))
    code = codewords(len(langs))
    target = code[[langs.index(v) for v in y]].astype(np.float32)
    aside = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    xt, tt = x[~aside].astype(np.float32), target[~aside]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb, n = np.zeros_like(w), np.zeros_like(b), len(xt)
    for _ in range(STEPS):
        g = -tt / (1 + np.exp(np.clip(tt * (xt @ w + b), -30, 30)))
        vw, vb = 0.9 * vw - 20 * (xt.T @ g / n + 1e-6 * w), 0.9 * vb - 2 * g.mean(0)
        w, b = w + vw, b + vb
    held = aside if aside.any() else ~aside
    right = ((x[held] @ w + b) * target[held] > 0).mean(0)
    return Model(langs, code, w, b, np.maximum(right - 0.5, 0.01) / np.maximum(right - 0.5, 0.01).sum() * len(right))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """One pass to count languages, one over the texts of the sample; only features of the sample come to the driver."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return fit(np.zeros((0, CELLS)), [])
    each = max(20, sample // len(counts))
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(each / n)) for lang, n in sorted(counts.items())])
    chosen = rows.where((F.pmod(F.xxhash64(F.lit("learn"), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)) < share)

    def run(batches):
        for batch in slices(batches):
            x = [features(t).astype(np.float16).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["doc_id", "lang", "x"])

    got = mapped(chosen.select("doc_id", "lang", "text"), run, "doc_id long, lang string, x binary").toPandas().sort_values(["doc_id", "lang"], kind="stable")
    x = np.stack([np.frombuffer(v, np.float16) for v in got["x"]]).astype(np.float32) if len(got) else np.zeros((0, CELLS), np.float32)
    return fit(x, got["lang"].tolist())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for each row; lang and source are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in slices(batches):
            lang, score, unsure = zip(*[m.decide(t) for t in batch.column(1).to_pylist()], strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with a language, all columns as they were: those that are `und`, and those so ambiguous that no codeword is nearer than the next by MARGIN, go. With no language to decide for, only texts that are null or have no letter go."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def kept(text: str | None) -> bool:
        if not sent.value.langs:
            return lettered(text)
        lang, _, unsure = sent.value.decide(text)
        return lang != UNDETERMINED and not unsure

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([kept(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return mapped(docs, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
