import zlib

import numpy as np

from tracewright.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string, held_out int"


def slow_vector(text):
    """The bundle of a text, letter by letter."""
    symbols = [0]
    for c in text or "":
        s = int(langid._alphabet()[ord(c)])
        if s or symbols[-1]:
            symbols.append(s)
    if symbols[-1]:
        symbols.append(0)
    base = {s: langid._letters(np.array([s]))[0].astype(int) for s in set(symbols)}
    out = np.zeros(langid.DIM)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        out += np.roll(base[a], 2) * np.roll(base[b], 1) * base[c]
    return out


def rows_of():
    texts = {"en": "the thing is on the other hand and with", "fr": "le chien est dans la maison avec élan", "de": "der Hund und die Katze für übermäßig"}
    rows = []
    for i in range(60):
        lang = list(texts)[i % 3]
        words = texts[lang].split()
        rows.append((i, " ".join(words[(i * 7 + k * k) % len(words)] for k in range(12)), lang, "x", 1))
    return rows


def test_against_slow_vectors(spark):
    rows = rows_of()
    got = {r.doc_id: r for r in langid.language_ids(spark.createDataFrame(rows, SCHEMA)).collect()}
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    langs = sorted({r[2] for r in train})
    unit = lambda v: v / np.linalg.norm(v)
    found = np.array([unit(sum(unit(slow_vector(r[1])) for r in train if r[2] == lang)) for lang in langs])
    mean = found.mean(axis=0)
    assert len(got) == len(rows)
    for d, text, *_ in rows:
        cosines = [unit(unit(slow_vector(text)) - mean) @ unit(p - mean) for p in found]
        assert got[d].lang_pred == langs[int(np.argmax(cosines))]
        assert abs(got[d].score - (max(cosines) + 1) / 2) < 1e-4
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)


def test_edge_cases(spark):
    rows = rows_of() + [(100, None, "en", "", 0), (101, "", "en", "", 0), (102, "12 !? \n", "fr", "", 0), (103, "the " * 400_000, None, "", 0), (None, "der", "de", "", 0), (104, "日本", None, "", 0), (5, "a", "en", "", 0), (5, "a", "en", "", 0)]
    got = [r for r in langid.language_ids(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(by[d].lang_pred, by[d].score) for d in (100, 101, 102)] == [("und", 0.0)] * 3
    assert by[103].lang_pred == "en" and by[None].lang_pred == "de" and by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)


def test_no_two_letters_share_a_vector():
    points = np.unique(langid._alphabet())[::40]
    assert len(np.unique(langid._letters(points), axis=0)) == len(points)
    vectors = langid._letters(points[:500]).astype(int)
    near = np.abs(vectors @ vectors.T - langid.DIM * np.eye(500, dtype=int)) / langid.DIM
    assert near.max() < 0.25 and near.mean() < 0.05


def test_more_languages_than_are_compared_at_once(spark, monkeypatch):
    rows = rows_of()
    whole = sorted(map(tuple, langid.language_ids(spark.createDataFrame(rows, SCHEMA)).collect()))
    monkeypatch.setattr(langid, "LANGS", 2)
    blocks = sorted(map(tuple, langid.language_ids(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert [r[:3] for r in blocks] == [r[:3] for r in whole]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(blocks, whole, strict=True))


def test_nothing_to_learn(spark):
    frame = spark.createDataFrame([(1, "text", None, "", 0)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in langid.language_ids(frame).collect()] == [("und", 0.0)]
    assert langid.language_ids(frame.limit(0)).count() == 0


def test_accuracy_on_held_out_texts(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = langid.op7_language_id(spark, sf).where("held_out").join(docs, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()
