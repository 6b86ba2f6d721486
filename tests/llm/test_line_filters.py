"""op8_lines: a shard's filter has room for the batches to come, so its shard's keys aren't read again to build it anew."""

from ionweave.llm import lines


def test_filters_have_room_for_all_batches(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    batch = lambda k: [(1000 * k + i, f"a line of some length, batch {k}, number {i}") for i in range(200)]
    index = lines.LineIndex(spark, 1)
    index.insert(frame(batch(0)))
    made = [lines.Cuckoo.load(bytes(r["filter"])) for r in index.filters.collect()]
    more = lines._halves([lines.line_key(t.encode(), 20) for _, t in batch(1)])
    assert len(made) == 1 and made[0].insert(more)
    index.insert(frame(batch(1)))
    assert lines.Cuckoo.load(bytes(index.filters.first()["filter"])).bits == made[0].bits
