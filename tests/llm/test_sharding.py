import zlib

import pytest

from tintwerk.llm import sharding


def check(rows, got, n):
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(n)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [0] * n
    for r in got:
        sizes[r.shard] += r.size
    most = max(r.size for r in got)
    assert all(abs(s - sum(sizes) / n) <= most for s in sizes)


@pytest.mark.parametrize("hot", [0, 400])
def test_shards_are_equal_and_slots_gapless(spark, hot):
    rows = [(i, "w" * (i * 37 % 900) + str(i % 50)) for i in range(600)] + [(1000 + i, "dieselbe") for i in range(hot)] + [(7, None), (7, ""), (None, None), (8, "é" * 2000)]
    docs = spark.createDataFrame([(*r, "s", None) for r in rows], "doc_id long, text string, source string, range int").repartition(7)
    got = sharding.shard_documents(docs, 24, carry=["text", "source"]).collect()
    check(rows, got, 24)
    for r in got:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.source) == (len(raw) + 8, zlib.crc32(raw), "s")
    by_text = {}
    for r in got:
        by_text.setdefault(r.text, set()).add(r.shard)
    small = [s for t, s in by_text.items() if t != "dieselbe"]
    assert sum(len(s) for s in small) <= len(small) + 24


def test_overfull_ranges_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 1)  # a poor sample leaves overfull ranges
    rows = [(i, "x" * (i % 90)) for i in range(900)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 6, ranges_per_shard=3).collect()
    check(rows, got, 6)


def test_edges(spark):
    schema = "doc_id long, text string, size int"
    assert sharding.shard_documents(spark.createDataFrame([], schema)).count() == 0
    got = sharding.shard_documents(spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "a", 1)], schema), 2).collect()
    check([1, 1, 1], got, 2)
    odd = spark.createDataFrame([(1, "a", 5, "x", 3, 9), (2, "b", None, None, None, None)], "doc_id long, text string, size int, Shard string, slot int, carried_slot int")
    got = sharding.shard_documents(odd, 2, carry=["text", "size", "Shard", "slot", "carried_slot"])
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "text", "carried_size", "carried_Shard", "carried_carried_slot", "carried_slot"]
    assert {(r.doc_id, r.size, r.carried_size, r.carried_Shard, r.carried_carried_slot, r.carried_slot) for r in got.collect()} == {(1, 9, 5, "x", 3, 9), (2, 9, None, None, None, None)}


def test_long_texts(spark):
    rows = [(i, "lang " * 300_000 if i == 5 else f"kurz {i}") for i in range(40)]
    check(rows, sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect(), 4)
