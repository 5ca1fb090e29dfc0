"""Components end as soon as all edges are stars."""

from objectlake.operators import components


def test_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars already are written once, as given; ids linked only to themselves stay."""
    names = []
    write = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name="step": names.append(name) or write(df, name))
    links = spark.createDataFrame([(5, 1), (1, 7), (9, 9), (9, None), (4, 2), (2, 2), (5, 1)], "a long, b long")
    found = {(r.id, r.component) for r in components.connected_components(links).collect()}
    assert found == {(1, 1), (5, 1), (7, 1), (9, 9), (2, 2), (4, 2)} and len(names) == 1
