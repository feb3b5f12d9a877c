import corpus_pipeline
import public_tokenizers
import sentencepiece
from llm.prose import lines, prose
from pyspark.sql import functions as F
from runledger.llm.common import kept_table
from runledger.llm.mixing import words_in
from runledger.llm.near_dedup import near_classes

SF = "/root/testdata/sf0.001"


def staged(spark, docs):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = kept_table(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_stages_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality, near, passages, mixed, pieces = staged(spark, docs)
    assert all(x.columns == docs.columns for x in (quality, near, passages, mixed))
    classes = {r["doc_id"]: r["class_id"] for r in near_classes(quality).collect()}
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(set(classes.values()))
    assert passages.count() == near.count()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = sorted((r["doc_id"], len(library.encode(r["text"]))) for r in mixed.collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in pieces.collect()) == expected
    assert abs(mixed.agg(F.sum(words_in("text"))).first()[0] - 1.5 * passages.agg(F.sum(words_in("text"))).first()[0]) < 50
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, pieces.collect()))


def test_planted_cases_and_odd_rows(spark, make):
    passage = " ".join(prose(9, 60))
    clean = [(i, lines(prose(100 + i, 120)), f"s{i % 3}") for i in range(30)]
    copies = [(100 + i, clean[0][1], "s0") for i in range(20)] + [(130, clean[1][1].replace(prose(101, 1)[0], "changed", 1), "s1")]
    sharing = [(200 + i, lines(prose(300 + i, 80)) + "\n" + passage, "s2") for i in range(6)]
    junk = [(300, "buy now " * 90, "s0"), (301, "short", "s0"), (302, None, "s0"), (303, "", None), (None, None, None)]
    quality, near, passages, mixed, pieces = staged(spark, make(clean + copies + sharing + junk))
    assert {r["doc_id"] for r in quality.collect()} == {r[0] for r in clean + copies + sharing}
    assert {r["doc_id"] for r in near.collect()} == {r[0] for r in clean + sharing}
    left = {r["doc_id"]: r["text"] for r in passages.collect()}
    assert all(left[i] == t for i, t, _ in clean) and passage in left[200]
    assert all(len(set(left[200 + i].split()) & set(passage.split())) < 35 for i in range(1, 6))
    assert pieces.count() == mixed.count()


def test_an_empty_table(spark, make):
    assert [x.count() for x in staged(spark, make([]))] == [0] * 5
