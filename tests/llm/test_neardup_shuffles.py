"""What near duplicates and components send and write."""

from newsrank.llm import neardup
from newsrank.operators import graph


def test_rows_of_nodes_of_one_set_stay_out_of_the_joins(spark, monkeypatch):
    seen = []
    held = neardup._held

    def watched(rows, columns, wanted, names):
        out = held(rows, columns, wanted, names)
        seen.append((columns, rows.count(), out.count(), wanted.join(rows, wanted[names[0]] == rows[columns[0]]).count()))
        return out

    monkeypatch.setattr(neardup, "_held", watched)
    text = lambda i: " ".join(f"w{(i * 131 + k * k * 7) % 5003}" for k in range(60))
    docs = spark.createDataFrame([(i, text(i)) for i in range(300)] + [(1000 + i, text(i) + " tail") for i in range(10)], "doc_id bigint, text string")
    got = neardup.near_duplicates(docs).where("component_id != doc_id").collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1000 + i, i) for i in range(10)]
    rows, kept, wanted = next(x[1:] for x in seen if x[0] == ["node"])
    assert rows == 24 * 310 and wanted <= kept < rows / 10


def test_components_of_stars_take_one_round(spark, monkeypatch):
    written = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df, *path: written.append(1) or cut(df, *path))
    edges = spark.createDataFrame([(i, 10 * (i // 10)) for i in range(100) if i % 10] + [(500, 501), (502, 501)], "a bigint, b bigint")
    got = {r.node: r.root for r in graph.connected_components(edges).collect()}
    assert got == {i: 10 * (i // 10) for i in range(100)} | {500: 500, 501: 500, 502: 500}
    assert len(written) == 2
