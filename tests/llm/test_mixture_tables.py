import pytest

from gridweft.llm import mixture


def wide(spark, n=1200, sources=600):
    rows = [(i, "word " * (1 + i % 7), ["en", "de"][i // sources % 2], f"s{i % sources}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_every_source_is_raked_and_keeps_its_target(spark):
    targets = {"source": {"s599": 0.2}}
    out = mixture.mix(wide(spark), targets=targets, keep=0.3).collect()
    cells = {(r.source, r.lang, r.topic): r.weight for r in out}
    assert len({r.source for r in out}) == 600 and mixture.OTHER not in {r.source for r in out}
    assert sum(w for (s, _, _), w in cells.items() if s == "s599") == pytest.approx(0.2, abs=1e-6)


def test_tables_and_driver_rake_alike(spark, monkeypatch):
    df, args = wide(spark, 300, 12), {"targets": {"source": {"s1": 0.3}, "lang": {"en": 0.5}}, "keep": 0.4}
    key = lambda r: r.doc_id
    driver = sorted(mixture.mix(df, **args).collect(), key=key)
    monkeypatch.setattr(mixture, "CELLS", 3)
    tables = sorted(mixture.mix(df, **args).collect(), key=key)
    for a, b in zip(driver, tables, strict=True):
        assert (a.source, a.lang, a.topic, a.tokens) == (b.source, b.lang, b.topic, b.tokens)
        assert a.weight == pytest.approx(b.weight, abs=1e-7) and a.probability == pytest.approx(b.probability, abs=1e-6)
