"""Near duplicates against brute force: tables that the usual fixtures don't have."""

import itertools
import pathlib
import time

import numpy as np
import pytest

from quillgraph.llm import _table, near_dedup


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_force(rows, percent=85):
    """doc_id -> component; rows of one doc_id are one document."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, x), (j, y) in itertools.combinations(sets, 2):
        if x and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def check(spark, rows, kind="long", percent=85):
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, f"doc_id {kind}, text string"), percent).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == brute_force(rows, percent)
    assert all(r.kept == (r.doc_id is None or r.component_id == r.doc_id) for r in out)


def around_a_licence(rng, n):
    """Unlike texts with a common passage, which share band keys, some of them in groups of near copies."""
    licence = [f"licence{k}" for k in range(200)]
    rows = []
    for k in range(n):
        own = [f"own{k}w{j}" for j in range(int(rng.integers(40, 90)))]
        rows.append((len(rows), " ".join([*licence, *own])))
        if k % 5 == 0:
            own[int(rng.integers(len(own)))] = "changed"
            rows.append((len(rows), " ".join([*licence, *own])))
    return rows


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 700])
def test_a_bucket_of_many_unlike_members(spark, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "APART", block // 2)
    rows = around_a_licence(np.random.default_rng(3), 60)
    check(spark, rows)


def test_unlike_members_of_a_bucket_do_not_meet(spark):
    # pairs at a similarity near 0.65 share band keys, but no prefix shingle
    rows = around_a_licence(np.random.default_rng(4), 40)
    seen = []
    of = near_dedup._between

    def counting(percent):
        run = of(percent)
        path = counter.value

        def counted(group):
            with open(path, "a") as f:
                f.write(f"{group.num_rows}\n")
            return run(group)

        return counted

    import tempfile

    with tempfile.NamedTemporaryFile() as f:
        counter = spark.sparkContext.broadcast(f.name)
        near_dedup._between = counting
        try:
            check(spark, rows)
        finally:
            near_dedup._between = of
        seen = [int(x) for x in open(f.name)]
    assert sum(n * n for n in seen) < len(rows) ** 2 / 4


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 300])
def test_borderline_chains(spark, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "APART", block)
    # each is like its neighbours only, so that links run through many that aren't like the centre
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(base[4 * k : 4 * k + 120])) for k in range(30)]
    check(spark, rows)
    check(spark, rows, percent=80)


def test_repeated_ids_of_differing_texts_and_text_ids(spark):
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(30))
    rows = [("d", one), ("d", two), ("c", two + " tail"), ("e", one + " tail"), ("f", "x"), ("f", None), (None, one), ("g", ""), ("e", one + " tail"), ("a", "y z"), ("b", "Y  Z")]
    check(spark, rows, "string")


def shuffled(spark):
    """Bytes of shuffle files that lie in Spark's local folders."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for at in folders for f in pathlib.Path(at).rglob("shuffle_*"))


def test_disk_holds_neither_former_steps_nor_texts_that_stand_alone(spark, tmp_path):
    rng = np.random.default_rng(9)
    # hexadecimal digits at random, so that compression leaves half of each text
    texts = [" ".join(rng.bytes(4).hex() for _ in range(300)) for _ in range(3000)]
    rows = [(k, t) for k, t in enumerate([*texts, *(t + " tail" for t in texts[:200])])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    before = shuffled(spark)
    near_dedup.deduplicate(docs).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(texts)
    time.sleep(2)  # files are deleted beside what follows
    most = sum(len(t) for _, t in rows)
    assert shuffled(spark) - before < most / 4


def test_perhaps_leaves_out_none(spark):
    ids = [None, "", "a", "b", *(f"id{k}" for k in range(0, 3000, 3))]
    docs = spark.createDataFrame([(x, "t") for x in [*ids, *(f"id{k}" for k in range(3000))]], "doc_id string, text string")
    out = _table.perhaps(docs, spark.createDataFrame([(x,) for x in [*ids, "a"]], "doc_id string")).collect()
    assert len(out) == docs.count()
    assert all(r.perhaps for r in out if r.doc_id in set(ids))
    assert sum(r.perhaps for r in out) < len(ids) * 2 + 10


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 700])
def test_turns_give_the_same_links(spark, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "APART", block // 2)
    monkeypatch.setattr(near_dedup, "TURN", 1)
    rows = around_a_licence(np.random.default_rng(6), 30)
    texts = [t for _, t in rows[:10]]
    check(spark, rows + [(1000 + k, t + " tail") for k, t in enumerate(texts)] + [(3, "another text of the same document, which nothing else is like"), (None, texts[0])])
