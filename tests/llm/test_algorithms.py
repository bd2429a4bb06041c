import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing, packing, splitting, survivors


def pieces_of(spark, text, limit=120, overlap=20):
    frame = spark.createDataFrame([(1, text)], "id long, text string")
    return [r.asDict() for r in splitting.split_texts(frame, "id", "text", limit, overlap).orderBy("piece_no").collect()]


@pytest.mark.parametrize(
    "text",
    ["", "short", "word " * 100, "x" * 500, "One sentence here. Another one follows!\n\n" * 12, "用水量下降了。" * 60, "á" * 300, "line\n" * 90, "\U0001f600" * 300, "a, b; c: d " * 50],
)
def test_splitting_round_trip(spark, text):
    found = pieces_of(spark, text)
    assert all(len(p["piece"]) <= 120 and p["chars"] == len(p["piece"]) for p in found)
    assert (len(found) > 1) == (len(text) > 120)
    rebuilt = ""
    for p in found:
        assert text[p["start"] : p["start"] + p["chars"]] == p["piece"]
        if p["piece_no"]:
            assert p["piece"][:20] == rebuilt[-20:]
        rebuilt = rebuilt[: p["start"]] + p["piece"]
    assert rebuilt == text


@pytest.mark.parametrize(("limit", "overlap"), [(72, 12), (10, 2), (9, 0), (120, 39)])
def test_splitting_keeps_any_limit(spark, limit, overlap):
    import random

    rng = random.Random(limit)
    parts = ["word ", "a.", "\n\n", "\n" + " " * 200 + "\n", ".\"'”" + ")" * 30 + " ", "。」」" * 9, "e\u0301" * 7, "\u0301" * 40, "x" * 90, ", ", "\t", "\U0001f600", "\r\n"]
    texts = ["A gap.\n" + " " * 200 + "\nB " * 30] + ["".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rebuilt = dict.fromkeys(range(len(texts)), "")
    for r in splitting.split_texts(frame, "id", "text", limit, overlap).orderBy("id", "piece_no").collect():
        assert r["chars"] == len(r["piece"]) <= limit and texts[r["id"]][r["start"] : r["start"] + r["chars"]] == r["piece"]
        if r["piece_no"]:
            assert r["start"] == len(rebuilt[r["id"]]) - overlap
        rebuilt[r["id"]] = rebuilt[r["id"]][: r["start"]] + r["piece"]
    assert list(rebuilt.values()) == texts


def test_splitting_prefers_paragraphs(spark):
    text = "A first paragraph that is fairly long indeed, yes. It goes on.\n\n" + "B second. " * 20
    assert pieces_of(spark, text)[0]["piece"].endswith("\n\n")


def test_splitting_tables_and_nulls(spark):
    rows = [[["abc", "de"]] * 40, [["x"]], [], None, [None, [None, "y"]]]
    frame = spark.createDataFrame([(i, r, "clash") for i, r in enumerate(rows)], "id long, rows array<array<string>>, piece string")
    found = splitting.split_tables(frame, "id", "rows", 60, 10).collect()
    assert {r["id"] for r in found if r["n_pieces"] > 1} == {0} and {r["id"] for r in found} == {0, 1, 2, 4}
    assert all(len(r["piece"]) <= 60 for r in found)
    assert splitting.split_texts(spark.createDataFrame([(1, None)], "id long, t string"), "id", "t", 60, 10).count() == 0
    with pytest.raises(ValueError):
        splitting.pieces(F.lit("x"), 10, 5)


def test_survivors(spark):
    rows = [
        (1, "a", 1.0, 0.5, "llm", ["f"], 10, "s1"),
        (2, "a", 2.0, 0.9, "manual", None, 20, None),
        (3, "b", 1.0, 0.5, "llm", None, 10, "s"),
        (4, "b", 1.0, 0.5, "llm", [], 10, "s"),
        (5, "c", None, None, "unknown", [], None, None),
        (6, "c", None, float("nan"), "llm", [], None, "kept"),
        (7, "d", 5.0, 0.9, "llm", [], 1, "old"),
        (8, "d", 6.0, 0.1, "llm", [], 2, "new"),
        (9, None, 6.0, 0.1, "llm", [], 2, "new"),
        (10, "e", 6.0, 0.1, "llm", [], 2, "new"),
    ]
    frame = spark.createDataFrame(rows, "id long, g string, value double, confidence double, extractor string, flags array<string>, extracted_at long, snippet string").withColumn("_trust", F.lit(9))
    trust = spark.createDataFrame([("llm", 3), ("manual", 5), ("manual", 4)], "extractor string, trust int")
    found = {r["g"]: r for r in survivors.survivors(survivors.with_trust(frame, trust), {"g": F.col("g")}, "id", ["value", "snippet"]).collect()}
    assert found["a"]["dominant_id"] == 2 and found["a"]["value"] == 2.0 and found["a"]["snippet"] == "s1"
    assert found["b"]["dominant_id"] is None and found["b"]["best_id"] == 3
    assert found["c"]["dominant_id"] == 6 and found["c"]["value"] is None and found["c"]["snippet"] == "kept"
    assert found["d"]["dominant_id"] is None and found["d"]["value"] == 6.0
    assert found["e"]["n"] == 1 and None not in found
    assert survivors.survivors(survivors.with_trust(frame.limit(0), trust), {"g": F.col("g")}, "id", ["value"]).count() == 0


def test_even_spelling(spark):
    names = ["Acme Oil", "acme_oil ", "ACME-OIL", "acme oil"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(survivors.even_spelling(F.col("n")).alias("e")).distinct().collect()
    assert [r["e"] for r in rows] == ["acmeoil"]


def test_hilbert_key_visits_neighbours():
    old = packing.BITS
    packing.BITS = 3
    try:
        grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
        keys = packing.hilbert_key((grid + 0.5) / 8)
        assert sorted(keys) == list(range(512))
        walk = grid[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
    finally:
        packing.BITS = old


def test_packing(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(0, 60, 800)] + [250, 100, 101, 0]
    frame = spark.createDataFrame([(i, s, i % 3 if i % 2 else int(rng.integers(0, 1000))) for i, s in enumerate(sizes)], "doc long, tokens long, key long").withColumn("id", F.lit(1))
    packed = packing.pack(frame, "doc", 100).toPandas()
    assert packed.groupby("container_id")["tokens"].sum().max() <= 100
    assert packed.groupby("doc")["tokens"].sum().sort_index().tolist() == sizes
    assert packed[packed.n_pieces > 1]["doc"].unique().tolist() == [800, 802] or set(packed[packed.n_pieces > 1]["doc"]) == {800, 802}
    assert sum(sizes) / (100 * packed["container_id"].nunique()) > 0.95
    assert packing.pack(frame.limit(0), "doc", 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(frame, "doc", 0)


def test_pack_documents(spark):
    texts = [("a b c",), (None,), ("",), ("word " * 400,), ("a b c",)]
    frame = spark.createDataFrame([(i, t) for i, (t,) in enumerate(texts)], "doc_id long, text string")
    packed = packing.pack_documents(frame, "doc_id", "text", 128).toPandas()
    assert set(packed["doc_id"]) == {0, 1, 2, 3, 4} and set(packed[packed.n_pieces > 1]["doc_id"]) == {3}


def test_rates():
    for mean, cap in ((0.3, 1), (0.99, 1), (1.7, 3), (4.9, 5), (0.0, 4), (513, 2_000), (600, 10_000), (700, 800), (9_990, 10_000)):
        assert mixing.capped_mean(mixing.rate_for(mean, cap), cap) == pytest.approx(mean, rel=1e-6, abs=1e-6)
    assert mixing.rate_for(600, 10_000) == pytest.approx(600, rel=1e-6)
    base, table = mixing.cumulative(mixing.rate_for(3, 3), 3)
    assert (base, len(table)) == (3, 0)
    base, table = mixing.cumulative(2.0, 4)
    assert base == 0 and table.tolist() == pytest.approx([0.135335, 0.406006, 0.676676, 0.857123], abs=1e-6)


def test_mixing_beyond_a_mean_of_512(spark):
    sized = spark.createDataFrame([(i, "rare", 10) for i in range(200)] + [(1000 + i, "big", 100) for i in range(4000)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("rare", 0.75, 10_000), ("big", 0.25, 1)], "source string, target_share double, max_repeats int")
    planned = mixing.plan(sized, targets)
    uses = mixing.mix(sized, planned).groupBy("source").agg(F.sum("tokens").alias("n"), F.max("copy_no").alias("k")).collect()
    held = {r["source"]: r for r in uses}
    # 201.5 uses of each rare document on average for the whole 402,000 tokens; ten times fewer documents need ten times as many.
    assert held["rare"]["n"] == pytest.approx(0.75 * 402_000, rel=0.01) and held["rare"]["k"] < 250
    few = sized.where("source = 'big' or doc_id < 40")
    rows = {r["source"]: r for r in mixing.shares(mixing.mix(few, mixing.plan(few, targets)), mixing.plan(few, targets)).collect()}
    assert rows["rare"]["reachable"] and 600 < rows["rare"]["most_uses"] < 900
    assert rows["rare"]["actual_share"] == pytest.approx(0.75, abs=0.005)


def test_mixing(spark):
    sized = spark.createDataFrame([(i, "big", 10) for i in range(8000)] + [(10000 + i, "small", 10) for i in range(1000)] + [(20000, "tiny", 10), (30000, None, 10), (30001, "unasked", 10)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 7), ("tiny", 0.1, 3), ("absent", 0.0, 2), (None, 0.5, 1), ("none", None, None)], "source string, target_share double, max_repeats int")
    planned = mixing.plan(sized, targets)
    mixed = mixing.mix(sized, planned, "doc_id")
    rows = {r["source"]: r for r in mixing.shares(mixed, planned).collect()}
    assert not rows["tiny"]["reachable"] and rows["tiny"]["most_uses"] == 3
    # The tenth that tiny can't fill goes to big and small in proportion to their targets.
    assert rows["big"]["share_of_plan"] == pytest.approx(0.5 / 0.9, abs=0.005) and rows["small"]["share_of_plan"] == pytest.approx(0.4 / 0.9, abs=0.005)
    assert rows["small"]["most_uses"] <= 7 and rows["absent"]["mixed_tokens"] == 0
    uses = mixed.toPandas()
    assert set(uses["source"]) == {"big", "small", "tiny"} and not uses.duplicated(["doc_id", "copy_no"]).any()
    assert (uses["shuffle_key"].diff().dropna() >= 0).all()
    total = sum(r["mixed_tokens"] for r in rows.values())
    assert total == pytest.approx(90_030, rel=0.005)
    assert all(r["actual_share"] == pytest.approx(r["attainable_share"], abs=0.005) for r in rows.values())
    exact = mixing.plan(sized, targets, exact_shares=True)
    small = {r["source"]: r for r in mixing.shares(mixing.mix(sized, exact, "doc_id"), exact).collect()}
    assert all(small[s]["attainable_share"] == pytest.approx(small[s]["target_share"]) for s in ("big", "small", "tiny"))
    assert mixing.shares(mixing.mix(sized.limit(0), mixing.plan(sized.limit(0), targets), "doc_id"), mixing.plan(sized.limit(0), targets)).count() == 5
