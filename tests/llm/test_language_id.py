"""Language models: the probabilities, held-out accuracy, rejection."""

import zlib
from types import SimpleNamespace

import cases
import numpy as np
import pytest
from cases import SF_SMALL

from cartlens.llm import language_id as op
from cartlens.llm import queries

LETTERS = op.alphabet()


def counted(texts):
    keys = np.concatenate([op.grams(p) for t in texts for p in op.pieces(op.symbols(t, LETTERS))])
    return np.unique(keys, return_counts=True)


def test_symbols():
    def seen(text):
        return "".join(map(chr, op.symbols(text, LETTERS).tolist()))

    assert seen("Ab, 12 É!\n") == " ab é "
    assert seen("x") == " x "
    assert [seen(t) for t in (None, "", "12 !?", " ")] == [""] * 4
    assert seen("a\U0001F600b") == " a b "
    assert len(op.symbols("\U00020000", LETTERS)) == 3
    # U+FFFE is no letter, beside other characters beyond the basic plane too
    assert [seen(t) for t in ("\uFFFE", "\uFFFE\U0001F600", "\uFFFF\U0001F600")] == [""] * 3
    assert seen("a\uFFFE\U0001F600b") == " a b "


def test_probabilities_sum_to_one():
    model = op.Model({"a": counted(["the cat sat on the mat", "a cat"]),
                      "b": counted(["der hund und der ball"])})
    vocabulary = model.keys[1]
    for context in (" th", " de", "zzz", "cat", "  x"):
        head = np.uint64(sum(ord(c) << 16 * (2 - i) for i, c in enumerate(context)))
        p = np.exp(model.log_probability(head << np.uint64(16) | vocabulary)).sum(0)
        unseen = np.exp(model.log_probability(
            np.array([head << np.uint64(16) | np.uint64(0x4E00)])))[0]
        assert p + unseen == pytest.approx([1, 1], abs=1e-9)


def test_by_hand():
    """One language, one word: the unigram level is what precedes each symbol."""
    model = op.Model({"a": counted(["ab"])}, op.ORDER)
    # grams "   a", "  ab", " ab " ; all counts 1, so the discount is 0.9
    d, kinds = 0.9, 4
    assert len(model.keys[1]) == 3
    p1 = (1 - d) / 3 + d / kinds
    p2 = (1 - d) + d * p1
    p3 = (1 - d) + d * p2
    p4 = (1 - d) + d * p3
    key = counted(["ab"])[0][0]
    assert np.exp(model.log_probability(np.array([key])))[0, 0] == pytest.approx(p4)


def test_long_texts_in_pieces(monkeypatch):
    text = cases.prose(3, 3000)
    x = op.symbols(text, LETTERS)
    model = op.Model({"a": counted([text[:5000]]), "b": counted([cases.prose(9, 900)])})
    whole = model.cross_entropy(x)
    keys = counted([text])
    assert keys[1].sum() == len(x) - 1
    monkeypatch.setattr(op, "_PIECE", 1000)
    assert [k.tolist() for k in counted([text])] == [k.tolist() for k in keys]
    assert model.cross_entropy(x)[0] == pytest.approx(whole[0])
    assert model.cross_entropy(x)[1] == pytest.approx(whole[1])


def test_held_out_accuracy(spark):
    sf = SF_SMALL.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in queries.op7_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)
               and 0 <= rows[d.doc_id].score <= 1 for d in docs)
    held = [d for d in docs if rows[d.doc_id].held_out]
    assert sum(rows[d.doc_id].lang_pred == d.lang for d in held) >= 0.99 * len(held)
    assert not any(r.rejected for r in rows.values())


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = cases.documents(spark)
    from pyspark.sql import functions as F

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    other = docs.withColumn("lang", F.when(fold == 0, "xx").otherwise(F.col("lang")))
    a, b = ({(r.doc_id, r.text): r[-1] for r in op.identify(docs, op.fit(d))[0].collect()}
            for d in (docs, other))
    assert a == b


def test_odd_rows_and_rejection(spark):
    docs = cases.documents(spark)
    out, name = op.identify(docs, op.fit(docs))
    assert out.columns[:-1] == docs.columns
    for r in out.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r[name].lang_pred == "und") == (not letters)
        assert letters or (r[name].rejected and r[name].score == 0)
    nothing = op.fit(cases.empty(spark))
    assert {r[name].lang_pred for r in op.identify(docs, nothing)[0].collect()} == {"und"}
    assert op.identify(cases.empty(spark), nothing)[0].count() == 0
    train = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    alien = spark.createDataFrame([(1, "жзцшщ ъьэю " * 60), (2, "qxzvkj wqxzj vkxq " * 60)],
                                  "doc_id long, text string")
    out, name = op.identify(alien, op.fit(train))
    assert all(r[name].rejected for r in out.collect())


@pytest.mark.parametrize("block", [op.BLOCK, 700])
def test_weights_in_blocks_equal_the_model_in_memory(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK", block)
    texts = {"a": [cases.prose(1, 300), "the cat"], "b": [cases.prose(2, 50), "漢字 \U00020000 가나"],
             "c": [cases.prose(7, 40)]}  # c: nothing in the second half
    halves = [{k: v[i:i + 1] for k, v in texts.items() if v[i:i + 1]} for i in (0, 1)]
    labelled = spark.createDataFrame([(k, i, t) for k, v in texts.items()
                                      for i, t in enumerate(v)], "lang string, half int, text string")
    scorers = op.learn(op.gram_counts(labelled))
    wanted = [cases.prose(1, 20), cases.prose(3, 2000), "漢字 zq", "", "x"]
    for scorer, known in zip(scorers, (*halves, texts), strict=True):
        model = op.Model({k: counted(v) for k, v in known.items()})
        sizes = [n for _, n, _ in scorer.blocks]
        assert max(sizes) <= block and (len(sizes) > 3 or block == op.BLOCK)
        assert sum(n for kind, n, _ in scorer.blocks if kind == 4) == sum(
            len(counted(v)[0]) for v in known.values())

        def score(batches, scorer=scorer):
            for b in batches:
                mean, spread, n = scorer.cross_entropy(b["text"].tolist())
                yield b.assign(mean=mean.tolist(), spread=spread, n=n)

        got = (spark.createDataFrame([(t,) for t in wanted], "text string").coalesce(1)
               .mapInPandas(score, "text string, mean array<double>, spread double, n long")
               .collect())
        for r in got:
            x = op.symbols(r.text, LETTERS)
            assert r.n == len(x)
            if len(x):
                mean, spread = model.cross_entropy(x)
                at = [scorer.languages.index(k) for k in model.languages]
                assert [r["mean"][j] for j in at] == pytest.approx(mean.tolist(), rel=1e-9)
                if min(r["mean"]) == min(mean):
                    assert r.spread == pytest.approx(spread, rel=1e-6)


def test_more_than_four_million_grams_that_are_seen_once(spark):
    """All of them are kept, so the language is still predicted."""
    r = np.random.default_rng(1)
    rows = [(i, "".join(map(chr, r.integers(0x4E00, 0x9FA5, 100_000))), "zh") for i in range(52)]
    rows += [(100 + i, cases.prose(i, 100), "en") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [i for i, _, lang in rows if lang == "zh" and zlib.crc32(str(i).encode()) % 5]
    assert len(learned) > 40
    out, name = op.identify(docs.withColumn("text", op.F.substring("text", 1, 500)), op.fit(docs))
    assert all(row[name].lang_pred == row.lang for row in out.collect())


def test_language_left_out_is_rejected(spark):
    docs = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/documents.parquet")
    judge = op.fit(docs.where("lang <> 'en'"))
    assert sorted(judge.limits) == ["de", "es", "fr"]
    assert all(0 < limit < 12 for *_, limit in judge.limits.values())
    out, name = op.identify(docs, judge)
    rows = out.collect()
    assert all(r[name].rejected for r in rows if r.lang == "en" and len(r.text) > 200)
    assert not any(r[name].rejected for r in rows if r.lang != "en")


def test_one_odd_text_does_not_move_a_limit(spark):
    rows = [("a", 2.0 + i % 20 / 100, 1.0, 500) for i in range(200)]
    limits = [op._limits(spark.createDataFrame(
        rows + odd, "lang string, entropy double, spread double, n long"),
        SimpleNamespace(floor=-4.0, languages=["a"]))["a"][3] for odd in ([], [("a", 60.0, 1.0, 500)])]
    assert limits[1] == pytest.approx(limits[0], rel=0.1)


def test_grams_do_not_reach_the_driver_as_rows(spark, monkeypatch):
    frame, seen = type(spark.range(1)), []
    for name in ("collect", "toPandas"):
        def fetch(self, plain=getattr(frame, name)):
            rows = plain(self)
            seen.append(len(rows))
            return rows
        monkeypatch.setattr(frame, name, fetch)
    rows = [(f"l{i}", cases.prose(i, 30)) for i in range(40)]
    labelled = spark.createDataFrame([(k, i % 2, t) for i, (k, t) in enumerate(rows)],
                                     "lang string, half int, text string")
    scorer = op.learn(op.gram_counts(labelled))[2]
    assert len(scorer.languages) == 40 and max(seen) <= 40
    assert sum(n for kind, n, _ in scorer.blocks if kind == 4) == sum(
        len(counted([t])[0]) for _, t in rows)


@pytest.mark.parametrize("few", [0, 1, 7, 8, 9, 31, 32, 33])
def test_limits_of_few_texts_are_wide_and_narrow_step_by_step(spark, few):
    schema = "lang string, entropy double, spread double, n long"
    many = [("a", 2.0 + i % 20 / 100, 1.0, 500) for i in range(400)]
    scorer = SimpleNamespace(floor=-4.0, languages=["a", "b"])

    def reach(rows):
        mean, between, within, limit = op._limits(spark.createDataFrame(rows, schema), scorer)["b"]
        return mean + limit * np.sqrt(between + within / 500)

    own = [("b", 2.5 + i % 20 / 100, 1.0, 500) for i in range(few + 1)]
    beside, alone = [reach(many + own[:n]) for n in (few, few + 1)], [
        reach(own[:n]) for n in (few, few + 1)]
    assert all(2.7 < x < 80 for x in beside + alone)
    # one text more never switches the rejection on or off
    assert all(0.5 < b / a < 1.5 for a, b in (beside, alone))
    assert few < 8 or alone[0] < reach([]) / 1.5


def test_ties_repeated_rows_and_clashing_names(spark):
    same = [(i, "ein satz mit worten", lang, 1) for i, lang in enumerate(["x", "w", "x", "w"] * 8)]
    docs = spark.createDataFrame(same + same[:3], "doc_id long, text string, lang string, language int")
    learned = {lang: [i for i, _, k, _ in same if k == lang and zlib.crc32(str(i).encode()) % 5]
               for lang in "wx"}
    train = docs.where(docs.doc_id.isin(learned["w"][:6] + learned["x"][:6]))
    train = train.dropDuplicates(["doc_id"])
    out, name = op.identify(docs, op.fit(train))
    assert name == "language_" and out.columns == [*docs.columns, name]
    found = out.collect()
    assert len(found) == len(same) + 3 and {r[name].lang_pred for r in found} == {"w"}
