"""Language identification: held-out accuracy, decoding, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelspark.llm import language_id as L
from panelspark.llm import queries


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    got = queries.QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").toPandas().merge(docs, on="doc_id")
    held = got[got.held_out]
    assert len(got) == len(docs) and 0.1 < got.held_out.mean() < 0.3
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_margins_by_brute_force():
    rng = np.random.default_rng(1)
    model = L.Model(["a", "b", "c"], rng.integers(0, 50, (3, len(L.GRAMS) * L.BUCKETS)))
    texts = ["", "Ab, cd! ef", "x" * 200_000, "é", "a", "zz top 12 zz"] * 3
    got = model.margins(*L.letters(pa.array(texts)))
    for i, text in enumerate(texts):
        data, _ = L.letters(pa.array([text]))
        rows = [model.odds[int(b) + k * L.BUCKETS] for k, n in enumerate(L.GRAMS) for b in L.buckets(data, n)]
        want = np.sum(rows, axis=0, dtype=np.float64) / (len(rows) + L.FEW) if rows else np.zeros(got.shape[1])
        np.testing.assert_allclose(got[i], want, rtol=1e-6, atol=1e-9)


def test_codewords_are_apart():
    for n in (4, 9, 40):  # two or three languages have too few different splits
        code = L.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert apart[~np.eye(n, dtype=bool)].min() >= 3


def test_odd_rows(spark):
    rows = [(1, None, None, 0), (2, "", "en", 1), (3, "123 !!", "en", 2), (4, "the end", "en", 3), (None, "été", "fr", 4), (4, "the end", "en", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = L.predict(docs, L.train(docs)).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("4", "en"), ("None", "fr")]
    assert all(r.score == 0 and r.ambiguous for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in L.predict(docs, L.train(docs.limit(0))).collect()} == {"und"}
    one = L.predict(docs, L.train(docs.filter("lang = 'en'"))).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("und", 0.0), ("en", 1.0)}
    assert L.predict(docs.limit(0), L.train(docs)).count() == 0


def test_columns_differ_and_one_wrong_bit_is_corrected():
    for n in (2, 3, 4, 5, 6, 12, 60, 300):
        code = L.codewords(n)
        splits = {tuple(c * c[0]) for c in code.T.tolist() for c in [np.array(c)]}
        assert len(splits) == code.shape[1] and all(len(set(s)) == 2 for s in splits)
        apart = (code.shape[1] - code @ code.T) / 2 + code.shape[1] * np.eye(n)
        if n >= 4:
            assert apart.min() >= 3
    rng = np.random.default_rng(3)
    model = L.Model(["a", "b", "c", "d"], rng.integers(0, 50, (4, len(L.GRAMS) * L.BUCKETS)))
    for word in range(4):
        for bit in range(model.code.shape[1]):
            wrong = model.code[word].astype(float)
            wrong[bit] *= -1
            assert model.decode(wrong[None])[0][0] == word


def brute_predict(texts, model):
    """Text by text and language by language, with plain sums."""
    out = []
    for text in texts:
        if text is None or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        data, _ = L.letters(pa.array([text]))
        raw = data.tobytes()
        total, size = np.zeros(model.code.shape[1]), 0
        for k, n in enumerate(L.GRAMS):
            for i in range(len(raw) - n + 1):
                h = 0
                for b in raw[i:i + n]:
                    h = (h * 0x01000193 + b) % 2 ** 32
                total += model.odds[(h * 0x9E3779B1 % 2 ** 32 >> 32 - 13) + k * L.BUCKETS]
                size += 1
        margin = total / (size + L.FEW)
        loss = [sum(np.log1p(np.exp(-m * c * L.SHARPNESS)) for m, c in zip(margin, word)) for word in model.code]
        share = np.exp(min(loss) - np.array(loss))
        best = int(np.argmin(loss))
        out.append((model.languages[best], share[best] / share.sum()))
    return out


def test_query_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    is_held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = L.train(docs.filter(~is_held))
    rows = docs.orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op8_language_id"](spark, "/root/testdata/sf0.001").collect()}
    for r, (lang, score) in zip(rows, brute_predict([r.text for r in rows], model)):
        g = got[r.doc_id]
        assert g.lang_pred == lang and abs(g.score - score) < 1e-9 and g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_number_signs_are_no_letters_and_any_number_of_labels(spark, monkeypatch):
    rows = [(1, "½ ² Ⅷ ① 5", "en"), (2, "a½", "en")] + [(10 + i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} " * 30, f"l{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    monkeypatch.setattr(L, "HELD", 7)
    model = L.train(docs)
    got = {r.doc_id: r.lang_pred for r in L.predict(docs, model).collect()}
    assert len(model.languages) == 301 and got[1] == "und" and got[2] != "und"
