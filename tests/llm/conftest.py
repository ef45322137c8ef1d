import pytest

from maskline.llm import jaccard, metric, phrases, suffixes


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    """Blocks, shards and cells small enough that a few texts make many of them."""
    for module in (jaccard, phrases, suffixes):
        monkeypatch.setattr(module, "BLOCK", 3000)
        monkeypatch.setattr(module, "SHARD", 20000)
    monkeypatch.setattr(jaccard, "GROUP", 3)
    monkeypatch.setattr(jaccard, "QUERIES", 4)
    monkeypatch.setattr(jaccard, "GROUPS", 2)
    monkeypatch.setattr(metric, "CELL", 40)
    monkeypatch.setattr(metric, "HOME_BLOCK", 16)
    monkeypatch.setattr(metric, "GUEST_BLOCK", 24)


@pytest.fixture(scope="session")
def documents(spark):
    """make(rows of (doc_id, text[, lang, source])): a table of documents with columns that clash with inner names."""

    def make(rows, slices=3):
        full = [(r[0], r[1], *(r[2:] or ("en", "a")), 1, 5, "x", True) for r in rows]
        schema = (
            "doc_id bigint, text string, lang string, source string, n_chars bigint, "
            "block bigint, shard string, kept boolean"
        )
        return spark.createDataFrame(full, schema).repartition(slices)

    return make
