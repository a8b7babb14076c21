"""The corpus pipeline: every stage's decisions against plain versions, odd and empty tables, and the registered query."""

import random

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from rivulet.llm import quality, secret_scan
from rivulet.llm.queries import JSON_VOCABULARY

STAGE = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score", "kept", "n_words"]


def corpus():
    rng = random.Random(31)
    word = lambda: "".join(rng.choice(["ta", "lo", "ri", "me", "nu", "sa"]) for _ in range(rng.randrange(1, 5)))
    texts, labels = [], []
    for i in range(400):
        w = [word() for _ in range(rng.randrange(60, 160))]
        bad, toxic = i % 9 == 0, i % 5 == 1
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["blockhead", "scoundrel", "numbskull"])
        texts.append(" ".join(x + "##" if bad and rng.random() < 0.5 else x for x in w))
        labels.append((i, int(not bad), int(toxic)))
    texts[2] += ' token = "0123456789abcdef0123456789abcdef01"'
    texts += [texts[4], texts[4] + " end", None, "", "short text"]
    return texts, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    texts, labels = corpus()
    rows = [(i, t, "en", None, len(t or ""), 0.5, "old", 7) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, n_words int").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([*labels, (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


@pytest.fixture(scope="module")
def outputs(spark, folder, tmp_path_factory):
    """What each stage returns, reread as Parquet."""
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{root}/{name}")
        docs = out[name] = spark.read.parquet(f"{root}/{name}")
    return out


def test_stages_are_in_order_and_keep_the_columns(outputs):
    assert list(outputs) == ["quality_rules", "toxicity", "ngram_jaccard_join", "secret_scan", "packing"]
    for name in list(outputs)[:-1]:
        assert outputs[name].columns == COLUMNS
        assert {(r["score"], r["kept"], r["n_words"], r["source"]) for r in outputs[name].collect()} == {(0.5, "old", 7, None)}


def test_decisions_take_effect(outputs):
    texts, labels = corpus()
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in outputs.items()}
    good = {i for i, q, _ in labels if q} | {400, 401}
    assert ids["quality_rules"] == good and all(quality.count_text(texts[i])[0] >= 50 for i in good)
    toxic = {i for i, _, x in labels if x}
    assert ids["toxicity"] == good - toxic
    assert ids["ngram_jaccard_join"] == good - toxic - {400, 401}
    assert ids["secret_scan"] == ids["packing"] == ids["ngram_jaccard_join"]


def test_secrets_are_gone_and_lengths_follow(outputs):
    for r in outputs["secret_scan"].collect():
        assert secret_scan.find_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
    assert "[SECRET]" in outputs["secret_scan"].where("doc_id = 2").first()["text"]


def test_sequences_are_the_tokens_of_the_documents(outputs):
    plain, pieces = Tokenizer.from_file(JSON_VOCABULARY), {}
    for r in outputs["packing"].orderBy("doc_id", "start").collect():
        pieces.setdefault(r["doc_id"], []).extend(r["ids"])
    for r in outputs["secret_scan"].collect():
        assert pieces[r["doc_id"]] == [*plain.encode(r["text"], add_special_tokens=False).ids, 1]


def test_run_equals_the_stages(spark, folder, outputs):
    got = entry.queries()["pipeline"](spark, folder)
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(got) == key(outputs["packing"])


def test_stages_take_odd_and_empty_tables(spark, folder):
    rows = [(None, None, None), (1, "", None), (1, "", None), (2, "same words here", 5), (2, "same words here", 5), (3, "x" * 70_000, 70_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == {"quality_rules": 0, "toxicity": 6, "ngram_jaccard_join": 5, "secret_scan": 6}.get(name, out.count())
        assert stage(spark, docs.where("false"), folder).count() == 0
    kept = STAGE["ngram_jaccard_join"](spark, docs, folder).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "1", "2", "3", "None"]


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
