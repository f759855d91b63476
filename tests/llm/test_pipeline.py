"""The pipeline's stages against plain Python over the same rows."""

import re

import corpus_pipeline
import pandas as pd
from pyspark.sql import functions as F

from offerlens.llm import quality_rules, segmentations, toxicity
from offerlens.llm.tables import stored

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set()


def least_of_each_group(texts):
    sets, least = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[a]]
    for _ in texts:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {i for i in texts if least[i] == i}


def windows(text):
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    return own, {tuple(own[i : i + 10]) for i in range(max(len(own) - 9, 1))} if own else set()


def clean_of(texts, items):
    wanted = set().union(*(windows(t)[1] for t in items))
    sizes = {len(w) for w in wanted}
    return {i for i, t in texts.items() if not any(tuple(own[k : k + n]) in wanted for own in [windows(t)[0]] for n in sizes for k in range(len(own) - n + 1))}


def test_stages(spark):
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs, outputs = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        texts = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            model = toxicity.fitted(docs, labels)
            expected = {i for i, s in zip(texts, model.scores(list(texts.values()))) if s < toxicity.THRESHOLD}
        elif name == "quality_rules":
            expected = set(pd.Series(list(texts))[quality_rules.measured.func(pd.Series(list(texts.values())))["kept"]])
        elif name == "near_duplicates":
            expected = least_of_each_group(texts)
        elif name == "decontamination":
            expected = clean_of(texts, items)
        out = stored(stage(spark, docs, SF), f"test-{name}")
        if name != "sentencepiece":
            assert out.columns == columns
            found = {r.doc_id: r.text for r in out.collect()}
            assert found == {i: texts[i] for i in expected} and out.count() == len(found)
        else:
            decode = segmentations.Vocabulary(segmentations.model_path()).decode
            rows = out.collect()
            assert {r.doc_id for r in rows} == set(texts) and all(decode(r.ids) == texts[r.doc_id] for r in rows)
        outputs.append(out)
        docs = out
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, outputs[-1].collect()))
    assert len(corpus_pipeline.STAGES) == 5 and docs.select(F.count("*")).first()[0] > 200
