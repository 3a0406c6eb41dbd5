import pytest

from quillgraph.llm import substring_dedup


def words(name, n):
    return [f"{name}x{k}" for k in range(n)]


@pytest.mark.parametrize("size", [55, 64, 90])
def test_passages_in_mid_sentence_after_prefixes_of_any_length(spark, size):
    passage = words("shared", size)
    texts = [(i, " ".join([*words(f"a{i}b", n), *passage, *words(f"c{i}d", 30)]) + ".") for i, n in enumerate([30, 33, 0, 12, 17, 29, 41, 5])]
    texts.append((20, " ".join([*passage[: size // 2], "another", *passage[size // 2 + 1 :]])))
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert out[0].text == texts[0][1] and out[0].n_removed == 0
    for i, t in texts[1:8]:
        left = out[i].text.split()
        stay = [w for w in left if w.startswith("shared")]
        # own words stay, and of the passage at most the ends
        assert [w for w in left if not w.startswith("shared")] == [w for w in t.split() if not w.startswith("shared")]
        assert len(stay) <= 30 and out[i].n_removed > 0
    assert "another" in out[20].text


def test_a_sentence_that_repeats_alone_stays(spark):
    line = " ".join(words("line", 24)) + "."
    texts = [(i, f"{' '.join(words(f'a{i}b', 9))}. {line} {' '.join(words(f'c{i}d', 9))}.") for i in range(4)]
    out = substring_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in out} == {i: (t, 0) for i, t in texts}
