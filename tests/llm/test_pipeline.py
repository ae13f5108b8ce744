"""The pipeline's stages, each held against a plain version on its own input."""

import cases
import corpus_pipeline
import public_tokenizers
import test_decontaminate
import test_line_dedup
import test_packing
import test_simhash
from cases import SF_SMALL
from tokenizers import Tokenizer

from cartlens.llm.common import stored


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def run_stages(spark, docs, sf_dir):
    """Each stage's input and output, written and read again as in a run."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, sf_dir), name)
        out.append((docs, after))
        docs = after
    return out


def held(spark, stages, sf_dir):
    (raw, spoken), (_, lines), (_, single), (_, clean), (_, packed) = stages
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes
    text = raw.columns.index("text")

    def texts(frame):
        return [r[text] for r in frame.collect()]

    letters = [t for t in texts(raw) if any(c.isalpha() for c in t or "")]
    assert sorted(texts(spoken)) == sorted(letters)

    ordered = spoken.collect()  # as stored, unless the ids give the order
    ids = [r.doc_id for r in ordered]
    if None not in ids and len(set(ids)) == len(ids):
        ordered.sort(key=lambda r: r.doc_id)
    want = test_line_dedup.brute([r.text for r in ordered])
    assert sorted(zip([str(r.doc_id) for r in ordered], want, strict=True)) == sorted(
        (str(r.doc_id), r.text) for r in lines.collect())
    assert all(r.n_chars == len(r.text) for r in lines.collect() if r.n_chars is not None)

    groups = test_simhash.expect([(r.doc_id, r.text) for r in lines.collect()])
    assert sorted(str(r.doc_id) for r in single.collect()) == sorted(
        {str(c) for _, _, c in groups})
    assert set(rows(single)) <= set(rows(lines))

    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet")
             .select("item_id", "text").collect()]
    bad = test_decontaminate.brute([(tuple(r), r.text) for r in single.collect()], bench)
    assert rows(clean) == sorted((k for k, v in bad.items() for x in v if not x[-1]), key=str)

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    test_packing.check(packed.collect(), texts(clean),
                       lambda x: t.encode(x or "", add_special_tokens=False).ids, 2048)
    return bad


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    stages = run_stages(spark, docs, SF_SMALL)
    bad = held(spark, stages, SF_SMALL)
    assert any(x[-1] for v in bad.values() for x in v)
    assert rows(corpus_pipeline.run(spark, SF_SMALL).drop("ids")) == rows(
        stages[-1][1].drop("ids"))


def test_odd_rows(spark):
    held(spark, run_stages(spark, cases.documents(spark), SF_SMALL), SF_SMALL)
    for _, after in run_stages(spark, cases.empty(spark), SF_SMALL):
        assert after.count() == 0


def test_lines_of_documents_without_a_length(spark):
    docs = spark.createDataFrame([(1, "one line of text\none line of text", "x"), (2, None, "y")],
                                 "doc_id long, text string, line_dedup string")
    got = corpus_pipeline.drop_repeated_lines(spark, docs, SF_SMALL)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, "one line of text", "x"), (2, None, "y")]
