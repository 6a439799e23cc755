import __spark_entry__ as e
from codelens.llm.containers import CAPACITY, best_fit, tokenizer


def test_best_fit_places_every_piece():
    lengths = {1500: 7, 548: 9, 1000: 5, 48: 30, 1: 3, 0: 2}
    fill, seen = {}, dict.fromkeys(lengths, 0)
    for length, _, n, first in best_fit(lengths):
        seen[length] += n
        for i in range(n if length else 1):
            fill[first + i] = fill.get(first + i, 0) + length
    assert seen == lengths and max(fill.values()) <= CAPACITY
    assert len(fill) <= 13


def test_p8_containers_hold_every_token(spark):
    d = "/root/testdata/sf0.01"
    rows = e.queries()["p8_containers"](spark, d).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    encoding, by_doc, fill = tokenizer(), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r.tokens)
        fill[r.container] = fill.get(r.container, 0) + r.tokens
    counts = {d: len(encoding.encode_ordinary(t)) for d, t in texts.items()}
    assert {d: sum(n) for d, n in by_doc.items()} == counts
    assert all(len(n) == 1 for d, n in by_doc.items() if counts[d] <= CAPACITY)
    capacity = {r.container: r.capacity for r in rows}
    assert all(fill[c] <= capacity[c] for c in fill) and sum(fill.values()) >= 0.97 * sum(capacity.values())
    assert all(fill[r.container] == r.used for r in rows)
