"""What a worker of the tokenizer holds does not grow with the rows of an incoming batch."""

import hashlib

import pyarrow as pa
import sentencepiece

from strandline.llm import pieces


def test_ids_leave_in_groups_of_texts(spark, monkeypatch):
    texts = [f"line {i} of a long text, " * 20_000 for i in range(6)] + [None, "", "short"]
    df = spark.createDataFrame([(0, "")], "doc_id bigint, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    run = pieces.round_trip(df, with_ids=True)
    held = []
    for made in (out := run([pa.RecordBatch.from_pydict({"doc_id": list(range(9)), "text": texts})])):
        held.append(made)
        assert sum(len(texts[i] or "") for i in made.column(0).to_pylist()) <= 1 << 20
    assert next(out, None) is None and len(held) >= 3
    rows = [r for b in held for r in b.to_pylist()]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for i, (r, t) in enumerate(zip(rows, texts, strict=True)):
        ids = library.encode(t or "")
        assert (r["doc_id"], r["n_tokens"], r["ids"]) == (i, len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
