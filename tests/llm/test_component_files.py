"""Rounds of the components write few files when there are few edges, whatever the shuffle partitions."""

from plumeflux.llm import components


def test_small_rounds_write_few_files(spark, monkeypatch):
    counts, cut = [], components.cut_lineage

    def counted(df):
        out = cut(df)
        counts.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components, "cut_lineage", counted)
    held = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = [(k, k + 1) for k in range(60) if k % 20 != 19]  # three paths of 20
        got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    assert got == {k: k // 20 * 20 for k in range(60)}
    assert len(counts) > 2 and max(counts[1:]) == 1
