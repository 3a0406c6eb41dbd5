from quillgraph.llm import pii


def chain(links):
    """Texts in which the identifiers of each link stand in a context that only those of the link before prove."""
    texts = [f"Reach me: u{i}@x.example.org today" for i in range(30)]
    for k in range(links):
        here, there = ("Reach me:", "today") if k == 0 else (f"re Handle{k}", f"ends{k}")
        for i in range(3):
            texts.append(f"{here} ID-{k}{i}9988 {there}")
            texts += [f"re Handle{k + 1} ID-{k}{i}9988 ends{k + 1}"] * 2
    return texts + [f"order 5544{i}3 pieces" for i in range(5)]


def test_identifiers_found_prove_further_patterns(spark):
    texts = chain(6)
    out = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in out:
        found = [texts[r.doc_id][s["start"] : s["end"]] for s in r.spans if s["kind"] == "context"]
        assert found == [w for w in texts[r.doc_id].split() if w.startswith("ID-")], texts[r.doc_id]
