"""The pipeline's stages against plain versions, one after the other, each on what its predecessor kept."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from barspark.llm.queries import public_tokenizer
from tests.conftest import SF

from . import brute


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        kept.append((rows(docs), out.columns, spark.read.parquet(str(tmp_path / name))))
        docs = kept[-1][2]
    assert all(columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, columns, _ in kept[:-1])

    before, _, after = kept[0]
    stats = {i: brute.statistics(r["text"]) for i, r in before.items()}
    fails = {i for i, s in stats.items() if s[0] < 10 or 100 * s[4] > 20 * s[0]}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()} - fails
    assert not fails & set(rows(after)) and len(good - set(rows(after))) <= 0.01 * len(good)

    before, _, after = kept[1]
    component = brute.link_components({i: brute.shingles(r["text"], 5) for i, r in before.items()}, 80)
    assert set(rows(after)) == {i for i, c in component.items() if i == c}
    assert all(r == before[i] for i, r in rows(after).items())

    before, _, after = kept[2]
    for i, r in rows(after).items():
        at, text = 0, ""
        for a, _, b, kind in brute.base_spans(before[i]["text"]):
            if a >= at:
                text += before[i]["text"][at:a] + f"<{kind}>"
            at = max(at, b)
        assert r["text"] == text + before[i]["text"][at:] and r["n_chars"] == len(r["text"])

    before, _, after = kept[3]
    t = Tokenizer.from_file(public_tokenizer("word_bpe_49k.json"))
    pieces = {}
    for p in after.collect():
        pieces.setdefault(p["doc_id"], []).append((p["start"], bytes(p["ids"])))
    for i, r in before.items():
        want = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 1], np.uint32).tobytes()
        assert b"".join(x for _, x in sorted(pieces[i])) == want


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.agg(F.count_distinct("doc_id")).first()[0] > 100 and "sequence_id" in out.columns
