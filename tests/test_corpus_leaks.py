"""Corpus -> detection -> scores, and the leak audit against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from maskline import fixed_values as fixed
from maskline.operators import corpus, detect, evaluate, leaks, spans
from maskline.sources import files


@pytest.fixture(scope="module")
def made(spark):
    return corpus.build_corpus(spark.range(400), 11).persist()


def gold_of(made):
    return made.select(F.col("id").alias("doc_id"), F.inline("entities")).withColumnRenamed("type", "entity_type")


def test_the_corpus_is_clean(spark, made):
    docs, gold = made.select(F.col("id").alias("doc_id"), "text"), gold_of(made)
    assert corpus.check_offsets(docs, gold).count() == 0
    assert corpus.check_no_overlap(gold).count() == 0
    assert corpus.check_identifiers(gold).count() == 0
    assert made.groupBy("kind").count().count() == len(corpus.KINDS)


def test_detection_finds_every_checked_identifier(spark, made):
    docs = made.select(F.col("id").alias("doc_id"), F.lit("fr").alias("lang"), "text")
    names = spark.createDataFrame([(n,) for n in corpus.FIRST_NAMES], "name string")
    found = spans.drop_contained(detect.detect_all(docs, names, fixed.MASKED_ENTITIES)).where("score >= 0.4")
    scores = {r.entity_type: r for r in evaluate.scores_per_type(gold_of(made), spans.merge_overlaps(found)).collect()}
    for kind in ("FR_NIR", "FR_FISCAL_NUMBER", "IBAN_CODE", "CREDIT_CARD", "PHONE_NUMBER", "EMAIL_ADDRESS", "IP_ADDRESS", "FR_ADDRESS", "PERSON"):
        assert (scores[kind].recall, scores[kind].precision) == (1.0, 1.0), kind


WORD = re.compile(r"\w+")


def private(row):
    """Words of items less those that stand somewhere outside of all items, by place."""
    inside = {i for e in row.entities for i in range(e.start, e.end)}
    outside = "".join(" " if i in inside else c for i, c in enumerate(row.text))
    elsewhere = {m.group() for m in WORD.finditer(outside)}
    return {m.group() for e in row.entities for m in WORD.finditer(e.value) if m.group() not in elsewhere}


def test_private_words(spark, made):
    annotated = made.select(F.col("id").alias("doc_id"), "text", "entities")
    rows = annotated.collect()
    found = {}
    for r in leaks.private_words(annotated).collect():
        found.setdefault(r.doc_id, set()).add(r.word)
    assert {r.doc_id: private(r) for r in rows if private(r)} == found


def test_leaked_values(spark, made):
    annotated = made.where("id < 120").select(F.col("id").alias("doc_id"), "text", "entities")
    rows = annotated.collect()
    texts = [("logs", i, made_text) for i, made_text in enumerate(
        [r.text[5:-9] for r in rows[::9]] + ["Claire 06", "xxAubryxx", "noise 12345 " + rows[4].text.split("\n")[0]])] + [("traces", 900, "Hugo\nPerrin"), ("traces", 901, "Édith")]
    records = spark.createDataFrame(texts, "place string, record_id long, text string")
    expected = set()
    for place in ("logs", "traces"):
        mine = [x for p, _, x in texts if p == place]
        seen = {w for x in mine for w in WORD.findall(x)}
        for r in rows:
            expected |= {(place, r.doc_id, e.value) for e in r.entities if any(e.value in x for x in mine)}
            expected |= {(place, r.doc_id, w) for w in private(r) if w in seen and ((w.isalpha() and len(w) >= 4) or (w.isdigit() and len(w) >= 5))}
    found = {tuple(r) for r in leaks.leaked_values(annotated, records).select("place", "doc_id", "leak").collect()}
    assert found == expected and len(expected) > 50


def test_bad_lines_are_kept_and_counted(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "kind": "k", "text": "Léa", "entities": [{"type": "PERSON", "start": 0, "end": 3, "value": "Léa"}]}\nnot json\n', encoding="utf-8")
    read = files.read_annotated(spark, str(tmp_path / "a.jsonl"))
    assert [r.id for r in read.collect()] == ["x", None]
    assert [tuple(r) for r in files.gold_of(read).collect()] == [("x", "PERSON", 0, 3, "Léa")]


def test_request_log_files(spark, tmp_path):
    (tmp_path / "debug.log").write_text(
        "INFO start\n  -d '{'model': 'small', 'messages': [{'role': 'user', 'content': \"l'été\"}], 'stream': False, 'stop': None}'\nINFO done\n", encoding="utf-8")
    [row] = files.read_request_log(spark, str(tmp_path)).collect()
    assert (row.model, row.messages[0].content, row.unreadable) == ("small", "l'été", False)


def test_first_names(spark):
    census = spark.createDataFrame([("JEAN-PIERRE", 300), ("JEAN-PIERRE", 250), ("PARIS", 900), ("_PRENOMS_RARES", 9000), ("ZOÉ", 499)], "preusuel string, nombre long")
    excluded = spark.createDataFrame([("Paris",)], "name string")
    assert [tuple(r) for r in corpus.first_name_dictionary(census, excluded).collect()] == [("Jean-Pierre", 550)]
