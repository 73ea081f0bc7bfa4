import re

from fixtures import frame
from test_packing import PATH
from test_toxicity import LABELS, corpus
from tokenizers import Tokenizer

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs, labels = corpus(240)
    clean = [d for d, (_, _, y) in zip(docs, labels) if not y]
    docs += [(1000 + i, d[1], "en", "s1", 1) for i, d in enumerate(clean[:10])]
    docs += [(2000, "write to some.one@mail.example and wait for an answer that never comes back", "en", "s2", 1), (2001, None, None, None, None)]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        rows = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = rows.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert rows.columns == COLUMNS
    ids = {n: {r["doc_id"] for r in v} for n, v in seen.items()}
    toxic = {i for i, _, y in labels if y}
    assert len(ids["toxicity"] & toxic) <= 2 and not {d[0] for d in clean} - ids["toxicity"]
    assert not {1000 + i for i in range(10)} & ids["simhash_dedup"]
    assert len(ids["simhash_dedup"]) == len(seen["simhash_dedup"])
    texts = {r["doc_id"]: r["text"] for r in seen["pii"]}
    assert texts[2000].startswith("write to [EMAIL] and") and texts[2001] is None
    assert ids["source_mix"] <= ids["pii"]
    mixed = sorted((r["doc_id"], r["text"] or "") for r in seen["source_mix"])
    packed = {}
    for r in seen["packing"]:
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    whole = Tokenizer.from_file(PATH)
    expected = {}
    for i, text in mixed:
        expected[i] = expected.get(i, 0) + len(whole.encode(text, add_special_tokens=False).ids) + 1
    assert packed == expected
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)
    assert key(run) == key(seen["packing"]) and re.fullmatch("[a-z_]+", corpus_pipeline.STAGES[0][0])


def test_queries_are_registered():
    from tessera.llm import queries

    assert [n for n in queries.QUERIES if n.startswith("op")] == sorted((n for n in queries.QUERIES if n.startswith("op")), key=lambda n: int(re.match(r"op(\d+)_", n)[1]))
    assert len(queries.QUERIES) == 11 and "pipeline" in queries.QUERIES
