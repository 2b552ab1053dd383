import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewright.llm import toxicity

SCHEMA = "doc_id long, text string, toxic int, held_out string"
LABELS = "doc_id long, quality int, toxic int, text string"


def discount(counts):
    one, two = sum(v == 1 for v in counts.values()), sum(v == 2 for v in counts.values())
    return one / (one + 2 * two) if one else 0.5


class Slow:
    """The models from their definitions, with dictionaries: ``ratio`` of a word after another."""

    def __init__(self, texts, toxic):
        n = toxicity.ORDER
        self.texts = [[t for t, x in zip(texts, toxic, strict=True) if bool(x) == c] for c in (False, True)]
        self.vocabulary = [{w for t in side for w in t} for side in self.texts]
        self.spelled = [Counter(r for w in names for r in self.runs(w)) for names in self.vocabulary]
        self.levels = {n: self.spelled[0] + self.spelled[1]}
        for k in range(n - 1, 0, -1):
            self.levels[k] = Counter(r[1:] for r in self.levels[k + 1])
        self.followers = {k: defaultdict(dict) for k in self.levels}
        for k, c in self.levels.items():
            for r, v in c.items():
                self.followers[k][r[:-1]][r] = v
        self.pairs, self.words = [], []
        for side in self.texts:
            triples = {x for t in side for x in zip([b"", b"", *t], [b"", *t], t, strict=False)}
            self.pairs.append(Counter((v, w) for _, v, w in triples))
            self.words.append(Counter(w for _, w in self.pairs[-1]))
        self.total = [Counter() for _ in range(2)]
        self.kinds = [Counter() for _ in range(2)]
        for c, pairs in enumerate(self.pairs):
            for (v, _), k in pairs.items():
                self.total[c][v] += k
                self.kinds[c][v] += 1

    @staticmethod
    def runs(w):
        n = toxicity.ORDER
        return [(b" " * (n - 1) + w + b" ")[i : i + n] for i in range(len(w) + 1)]

    def shared(self, r):
        if not r:
            return 1 / 256
        after, d = self.followers[len(r)][r[:-1]], discount(self.levels[len(r)])
        return (after[r] - d + d * len(after) * self.shared(r[1:])) / sum(after.values())

    def spelling(self, w, c):
        out, d = 0.0, discount(self.spelled[c])
        for r in self.runs(w):
            after = {q: v for q, v in self.spelled[c].items() if q[:-1] == r[:-1]}
            known = any(q[:-1] == r[:-1] for q in self.levels[toxicity.ORDER])
            left = d * len(after) / sum(after.values()) if after else 1.0
            if r in self.levels[toxicity.ORDER]:
                out += math.log(max(after.get(r, 0) - d, 0) / max(1, sum(after.values())) + left * self.shared(r))
            else:
                out += (math.log(left) if known else 0.0) - math.log(256)
        return out

    def left(self, c):
        return max(1, len(self.words[c])) / max(1, sum(self.words[c].values()))

    def word(self, w, c):
        return max(self.words[c][w] - 1, 0) / max(1, sum(self.words[c].values())) + self.left(c) * math.exp(self.spelling(w, c))

    def ratio(self, v, w):
        if max(self.words[0][w], self.words[1][w]) < 2 and max(self.pairs[0][v, w], self.pairs[1][v, w]) < 2:
            return self.spelling(w, 1) + math.log(self.left(1)) - self.spelling(w, 0) - math.log(self.left(0))
        if max(self.pairs[0][v, w], self.pairs[1][v, w]) < 2:
            return math.log(self.word(w, 1) / self.word(w, 0))
        prior = toxicity.PRIOR
        free = (self.kinds[0][v] + self.kinds[1][v] + 2 * prior) / (self.total[0][v] + self.total[1][v] + 2 * prior)
        p = [max(self.pairs[c][v, w] - 1, 0) / (self.total[c][v] + prior) + free * self.word(w, c) for c in (0, 1)]
        return math.log(p[1] / p[0])

    def features(self, words):
        r = [self.ratio(v, w) for v, w in zip([b"", *words], words, strict=False)]
        if not r:
            return [0.0] * 6
        worst = [max(sum(r[i : i + min(k, len(r))]) for i in range(len(r) - min(k, len(r)) + 1)) / min(k, len(r)) for k in toxicity.PASSAGES]
        out = [sum(r) / len(r), *worst, sum(math.log(1 - toxicity.SHARE + toxicity.SHARE * math.exp(min(x, 50))) for x in r)]
        return [math.copysign(math.sqrt(abs(x)), x) for x in out]


def low(text):
    return (text or "").encode().translate(toxicity.LOWER)


def rows_of(n=400):
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [f"w{(i * 7 + k * k) % 50}" for k in range(40)]
        if bad:
            words[i % 40] = "Scum" + "abcdefgh"[i % 8]
        docs.append((i, " ".join(words), None, "x"))
        labels.append((i, 1, int(bad), "x"))
    return docs, labels


@pytest.fixture
def small_prior():
    old, toxicity.PRIOR = toxicity.PRIOR, 3
    yield
    toxicity.PRIOR = old


def test_ratios_from_the_definitions(small_prior):
    texts = ["the cat sat on the mat", "the dog sat", "you idiot the cat", "idiots the dog idiot", "a a a catalogue", "shut up you", "do shut up the cat", "please shut up idiot", "shut the dog", "up the cat sat idiot"]
    toxic = [False, False, True, True, False, True, True, True, False, False]
    model, slow = toxicity.Ratios([low(t) for t in texts], toxic), Slow([low(t).split() for t in texts], toxic)
    assert len(model.pairs) >= 2
    for text in (*texts, "idiotic zebra dogs é a shut up", "Shut UP shut up the mat", "up shut"):
        words = low(text).split()
        want = [slow.ratio(v, w) for v, w in zip([b"", *words], words, strict=False)]
        assert np.abs(model.of([low(text)])[0] - want).max() < 1e-4, text


def test_an_expression_of_two_words_weighs_more_than_its_words(small_prior):
    toxic = [f"x{i} get lost y{i}" for i in range(30)] + [f"{i} lost" for i in range(3)]
    plain = [f"get x{i} y{i}" for i in range(20)] + [f"x{i} y{i} lost z{i}" for i in range(30)] + [f"q{i} get home" for i in range(20)]
    model = toxicity.Ratios([low(t) for t in toxic + plain], [True] * len(toxic) + [False] * len(plain))
    ratio = lambda t: model.of([low(t)])[0].sum()
    assert ratio("get lost") > ratio("lost get") + 0.5


def test_the_whole_query_against_brute_force(spark):
    """Sample, models, features, calibration and scores, worked out again without any of the operator's code for them."""
    docs, labels = rows_of(120)
    docs += [(1000, None, 1, ""), (1001, "", 1, ""), (1003, "SCUMa w1 w2 " * 7, 0, "")]
    crc = lambda i: zlib.crc32(str(i).encode())
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()}
    text, toxic = {d[0]: low(d[1]).split() for d in docs}, {x[0]: x[2] for x in labels}
    known = sorted(i for i in toxic if crc(i) % 4 != 2)
    fitting, rest = [i for i in known if crc(i) // 4 % 5], [i for i in known if crc(i) // 4 % 5 == 0]
    slow = Slow([text[i] for i in fitting], [toxic[i] for i in fitting])
    x, y = np.array([slow.features(text[i]) for i in rest]), np.array([toxic[i] for i in rest], float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, w = np.column_stack(((x - mean) / scale, np.ones(len(x)))), np.zeros(7)
    keep = np.array([1.0] * 6 + [1e-3])
    for _ in range(60_000):  # plain descent on the penalized likelihood, which has one minimum
        w -= 0.5 / len(x) * (z.T @ (1 / (1 + np.exp(-z @ w)) - y) + keep * w)
    share = sum(toxic[i] for i in known) / len(known)
    shift = math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    for i, words in text.items():
        want = 1 / (1 + math.exp(-(((np.array(slow.features(words)) - mean) / scale) @ w[:-1] + w[-1] + shift)))
        assert abs(got[i].score - want) < 2e-3, i
        assert got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == (crc(i) % 4 == 2)


def test_learns_and_defines_odd_rows(spark):
    docs, labels = rows_of()
    docs += [(1000, None, 1, ""), (1001, "", 1, ""), (None, "scuma", 1, ""), (1002, "w1 " * 200_000, 0, ""), (1002, "w1 " * 200_000, 0, ""), (1003, "SCUMa w1 w2", 0, "")]
    labels += [(1000, None, None, ""), (5000, 1, 1, ""), (None, 1, 1, ""), (3, 0, 0, ""), (3, 0, 0, "")]
    got = toxicity.toxicity(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    for i in range(400):
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert by[i].predicted == int(by[i].score >= 0.3) == int(i % 5 == 0)
    assert by[1003].predicted == 1 and len({r.score for r in got if r.doc_id == 1002}) == 1
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn(spark):
    docs, labels = rows_of(8)
    frame, marks = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    assert {r.score for r in toxicity.toxicity(frame, marks.limit(0)).collect()} == {0.0}
    assert {r.predicted for r in toxicity.toxicity(frame, marks.where("toxic = 0")).collect()} == {0}
    assert toxicity.toxicity(frame.limit(0), marks).count() == 0


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    docs, labels = rows_of(300)
    frame = spark.createDataFrame([*docs, (900, "w " * 5000, None, "")], SCHEMA)
    marks = spark.createDataFrame([*labels, (900, 1, 1, "")], LABELS).selectExpr("doc_id", "toxic > 0 AS toxic")
    count = lambda rows, most: toxicity.sampled(frame.select("doc_id", "text"), marks, rows, most)
    assert count((10, 20), 1 << 30).count() == 30
    some = count((100, 300), 1 << 12).collect()
    assert 1 < len(some) and sum(len(r.text) for r in some) <= 1 << 12
    assert 900 not in {r.doc_id for r in count((100, 300), 1 << 16).collect()}


def test_held_out_documents(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.op10_toxicity(spark, sf).where("held_out").join(labels, "doc_id").select("score", "toxic").toPandas()
    rank, bad = rows.score.rank(), rows.toxic == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.96
