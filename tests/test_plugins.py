"""User detectors: their contract, their failures, and detect_all with them."""

import re

import pytest

from maskline.operators import detect
from maskline.operators.plugins import Detector, Registry, plugin_problems, plugin_rows, plugin_spans
from maskline.plans.masking import mask_conversations


def finder(pattern, kind, score=0.9):
    return lambda texts: [[(*m.span(), kind, score) for m in re.finditer(pattern, t)] for t in texts]


def docs_of(spark, *texts):
    return spark.createDataFrame([(i, "fr" if i % 2 == 0 else None, t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")


def test_spans_and_languages(spark):
    docs = docs_of(spark, "Réf. 𝄞 AB-12 et CD-3", "AB-99", None, "", "AB-1")
    every = Detector("refs", ("REF",), finder(r"[A-Z]{2}-[0-9]+", "REF"))
    french = Detector("fr", ("FR", "REF"), finder("AB", "FR", 0), languages=("fr",))
    found = sorted((r.doc_id, r.start, r.end, r.value, r.entity_type, r.score, r.recognizer, r.original_score, r.checksum) for r in plugin_spans(docs, [every, french]).collect())
    assert found == [
        (0, 7, 9, "AB", "FR", 0.0, "fr", 0.0, None), (0, 7, 12, "AB-12", "REF", 0.9, "refs", 0.9, None), (0, 16, 20, "CD-3", "REF", 0.9, "refs", 0.9, None),
        (1, 0, 5, "AB-99", "REF", 0.9, "refs", 0.9, None), (4, 0, 2, "AB", "FR", 0.0, "fr", 0.0, None), (4, 0, 4, "AB-1", "REF", 0.9, "refs", 0.9, None),
    ]
    assert {r.entity_type for r in plugin_spans(docs, [every, french], ["FR"]).collect()} == {"FR"}
    assert plugin_rows(docs.limit(0), [every]).collect() == []


@pytest.mark.parametrize(
    ("span", "why"),
    [
        ((-1, 2, "A", 0.5), "outside of the text"), ((2, 2, "A", 0.5), "outside of the text"), ((3, 1, "A", 0.5), "outside of the text"), ((0, 7, "A", 0.5), "outside of the text"),
        ((0, 1.0, "A", 0.5), "a place is not a whole number"), ((True, 2, "A", 0.5), "a place is not a whole number"), ((None, 2, "A", 0.5), "a place is not a whole number"),
        ((0, 1, "B", 0.5), "undeclared type"), ((0, 1, None, 0.5), "undeclared type"), ((0, 1, "A", 1.5), "no score from 0 to 1"), ((0, 1, "A", float("nan")), "no score from 0 to 1"),
        ((0, 1, "A", None), "no score from 0 to 1"), ((0, 1, "A"), "not (start, end, type, score)"), ("0123", "not (start, end, type, score)"), (None, "not (start, end, type, score)"),
    ],
)
def test_bad_spans_are_told(spark, span, why):
    detector = Detector("d", ("A",), lambda texts: [[span, (0, 6, "A", 1)] for _ in texts])
    rows = plugin_rows(docs_of(spark, "sixsix"), [detector]).collect()
    assert sorted((r.value or "", r.problem or "") for r in rows) == [("", f"bad span: {why}"), ("sixsix", "")]


def test_failures_stay_with_their_text_and_detector(spark):
    calls = spark.sparkContext.accumulator(0)

    def breaks(texts):
        calls.add(1)
        if any("bad" in t for t in texts):
            raise RuntimeError("x" * 500)
        return [[(0, 1, "A", 1.0)] for _ in texts]

    broken = Detector("broken", ("A",), breaks, batch=10)
    short = Detector("short", ("A",), lambda texts: [[]] if len(texts) == 1 and "bad" in texts[0] else [])
    lazy = Detector("lazy", ("A",), lambda texts: ((s for s in [(0, 1, "A", 1 / (len(t) - 3))]) for t in texts))
    docs = docs_of(spark, *[f"{'bad' if i == 17 else 'good'}{i}" for i in range(30)]).coalesce(1)
    spans = plugin_spans(docs, [broken, short, lazy]).collect()
    assert sorted(r.doc_id for r in spans if r.recognizer == "broken") == [i for i in range(30) if i != 17]
    problems = plugin_problems(docs, [broken, short]).collect()
    assert [(r.doc_id, r.problem) for r in problems if r.recognizer == "broken"] == [(17, ("failed: RuntimeError: " + "x" * 500)[: len("failed: ") + 200])]
    assert sorted(r.doc_id for r in problems if r.recognizer == "short") == [i for i in range(30) if i != 17]
    assert calls.value <= 2 * (3 + 10)  # only the batch that failed is tried text by text


def test_registry():
    registry = Registry()
    registry.add(Detector("a", ("X", "Y"), len))
    registry.add(Detector("b", ("Z",), len))
    with pytest.raises(ValueError, match="already"):
        registry.add(Detector("a", ("X",), len))
    assert [d.name for d in registry.detectors(["Y", "Z"])] == ["a", "b"] and [d.name for d in registry.detectors(["Z"])] == ["b"]
    registry.remove("a")
    assert [d.name for d in registry.detectors()] == ["b"]
    for bad in ({"name": ""}, {"entity_types": ()}, {"find": None}, {"batch": 0}):
        with pytest.raises(ValueError, match="needs"):
            Detector(**({"name": "n", "entity_types": ("A",), "find": len} | bad))


def test_masking_with_a_plugin(spark):
    messages = spark.createDataFrame([(1, 0, "dossier AB-12, m@example.com"), (1, 1, "encore AB-12 et CD-4")], "conv_id long, turn int, text string")
    refs = Detector("refs", ("REF",), finder(r"[A-Z]{2}-[0-9]+", "REF"), languages=("fr",))
    masked, _ = mask_conversations(messages, plugins=[refs], entities=["REF", "EMAIL_ADDRESS"])
    assert [r.masked_text for r in masked.orderBy("turn").collect()] == ["dossier <REF_1>, <EMAIL_ADDRESS_2>", "encore <REF_1> et <REF_3>"]
    docs = messages.select("conv_id", "text").withColumnRenamed("conv_id", "doc_id").selectExpr("doc_id", "'fr' as lang", "text")
    assert {r.recognizer for r in detect.detect_all(docs, plugins=[refs]).collect()} == {"refs", "Email"}
    assert "refs" not in {r.recognizer for r in detect.detect_all(docs, entities=["EMAIL_ADDRESS"], plugins=[refs]).collect()}
