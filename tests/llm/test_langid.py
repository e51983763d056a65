"""Language identification: codes, counts over pieces, held-out accuracy, odd rows."""

import zlib

import numpy as np

from subsight.llm import langid

BASE = "/root/testdata/sf0.01"


def test_codewords_differ_in_every_bit_and_row():
    for n in (1, 2, 4, 6, 7, 20):
        code = langid.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0}
        assert all((code[i] != code[j]).any() for i in range(n) for j in range(i))
        assert code.shape[1] == 0 or (abs(code.sum(axis=0)) < n).all()
    four = langid.codewords(4)
    assert min((four[i] != four[j]).sum() for i in range(4) for j in range(i)) == 4  # one wrong bit is corrected


def test_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Über den Wolken, naïve 12 cafés!\n".encode() * 40
    whole = langid.ngram_counts(text)
    assert whole.sum() == sum(len(text) + 2 - n + 1 for n in langid.SIZES)
    for size in (1, 2, 3, 7, 100):
        monkeypatch.setattr(langid, "PIECE", size)
        assert (langid.ngram_counts(text) == whole).all()


def test_one_wrong_bit_is_corrected():
    code = langid.codewords(4)
    model = langid.LanguageModel(list("abcd"), code, np.eye(code.shape[1], dtype=np.float32), np.zeros(code.shape[1]))
    for row in range(4):
        for bit in range(code.shape[1]):
            margins = 3 * code[row].copy()
            margins[bit] *= -1
            assert model.decode(margins[None])[0][0] == row


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()}
    rows = langid.op8_language(spark, BASE).collect()
    assert {r["doc_id"] for r in rows} == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_odd_rows(spark):
    rows = [(k, ("der die und ist nicht" if k % 2 else "the and of with that") + f" {k}", "de" if k % 2 else "en") for k in range(60)]
    rows += [(None, "the", "en"), (70, None, "en"), (71, "the of", None), (72, "", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.languages == ["de", "en"]
    odd = [(1, None), (2, ""), (3, "12 %!"), (4, "und nicht der " * 90000), (None, "that with the"), (6, "日本")]
    texts = spark.createDataFrame([(k, x, "zz", 0.5) for k, x in odd] * 2, "doc_id long, text string, lang string, score double")
    got = langid.predict(texts, model).collect()
    assert len(got) == 2 * len(odd)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[k]["lang_pred"] for k in (1, 2, 3, 4, None)] == ["und", "und", "und", "de", "en"]
    assert by_id[6]["lang_pred"] in model.languages and by_id[1]["score"] == 0
    unlearned = langid.train(df.limit(0))
    assert {r["lang_pred"] for r in langid.predict(texts, unlearned).collect()} == {"und"}
    assert langid.predict(texts.limit(0), model).collect() == []


def plain_prediction(model, text):
    """``(language, probability)`` by loops over n-grams, bits and languages."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    folded = b" " + b"".join(bytes([b]) if b >= 128 else bytes([b]).lower() if bytes([b]).isalpha() else b" " for b in text.encode()) + b" "
    counts = {}
    for size in (2, 3, 4):
        for at in range(len(folded) - size + 1):
            h = size
            for b in folded[at : at + size]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
            bucket = ((h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF) >> 20
            counts[bucket] = counts.get(bucket, 0) + 1
    total = sum(counts.values())
    margins = [model.bias[bit] + sum((n / total) ** 0.5 * model.weights[g, bit] for g, n in counts.items()) for bit in range(model.code.shape[1])]
    losses = [sum(np.log(1 + np.exp(-m * c)) for m, c in zip(margins, row, strict=True)) for row in model.code]
    weights = [np.exp(min(losses) - x) for x in losses]
    best = int(np.argmin(losses))
    return model.languages[best], weights[best] / sum(weights)


def test_query_against_plain_decoding(spark):
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    model = langid.train(docs.where(langid.remainder("doc_id", 5) != 0))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = langid.op8_language(spark, base).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        lang, score = plain_prediction(model, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3, r["doc_id"]


def test_repeated_ids_teach_as_often_as_they_occur(spark):
    """A document given twice, or with two labels, is as many rows; none is an error."""
    rows = [(k, "the and of" if k % 2 else "der die und", "en" if k % 2 else "de") for k in range(40)]
    model = langid.train(spark.createDataFrame(rows + rows[:10] + [(0, "der die und", "en")], "doc_id long, text string, lang string"))
    got = langid.predict(spark.createDataFrame([(1, "the of"), (2, "die der")], "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "en", 2: "de"}
